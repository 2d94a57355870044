"""Mixing sources to target weights by iterative proportional fitting, with DataFrame operations only (operator 1).

Documents become cells (source, language, topic) with their tokens; only the cells are raked. The fit is capped: a cell
never gets more tokens than it has, so each cell's weight over its tokens is a probability, and documents are then
drawn by a hash of their id. Targets that a value's tokens can't meet are lowered to what is there, and what they lose
goes to the other values in proportion. A cell's probability is min(1, q), q being a product of a factor for each margin;
a step scales one margin's cells that are under the cap to what the others leave, and sweeps go on until all margins are
met. The cell table is as long as there are combinations, whatever the rows: behind a count of it, it is raked in one row
of arrays and broadcast, and beyond that by shuffles and joined with Spark's skew handling.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadflow.session import cut, table

MARGINS = ("source", "lang", "topic")
#: Without given targets a margin's values weigh as their tokens to this power.
TEMPERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
RATE, SEED = 0.8, 17
#: Sweeps end when no margin is off by more than this share of its target, or after so many.
TOLERANCE, SWEEPS = 1e-9, 200
BROADCAST_CELLS = 100_000
#: A topic is one of so many terms; a term is the first TERM code points of longer words, in at most one in RARE documents.
TOPICS, TERM, RARE = 16, 5, 10
_SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Runs of characters other than white space, with an empty string before or after them where white space is."""
    return F.split(F.coalesce(text, F.lit("")), _SPACE)


def _terms(w: Column) -> Column:
    return F.transform(F.filter(w, lambda x: F.char_length(x) > TERM), lambda x: F.substring(x, 1, TERM))


def topics(docs: DataFrame, n_topics: int = TOPICS) -> list[str]:
    """The terms that stand for topics: those in most documents (rows) among all in at most one of RARE, ties in order of the
    term. Every word of every row counts; n_topics rows come back."""
    n = docs.count()
    found = docs.select(F.explode(F.array_distinct(_terms(words(F.col("text"))))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return [r.term for r in found.where(F.col("n") * RARE <= n).orderBy(F.desc("n"), "term").limit(n_topics).collect()]


def _let(x: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(x), f)[0]


def topic(w: Column, n_tokens: Column, terms: list[str]) -> Column:
    """The topic's term that occurs most in these words, the first of `terms` if equal; `empty` without tokens, `other` without
    any of the terms."""
    known = F.array(*(F.lit(t) for t in terms)) if terms else F.array().cast("array<string>")
    count = lambda hits: F.transform(known, lambda a: F.size(F.filter(hits, lambda x: x == a)))
    first = lambda times: known[(F.array_position(times, F.array_max(times)) - 1).cast("int")]
    most = lambda hits: F.when(F.size(hits) > 0, _let(count(hits), first))
    best = _let(F.filter(_terms(w), lambda x: F.array_contains(known, x)), most)
    return F.when(n_tokens == 0, "empty").otherwise(F.coalesce(best, F.lit("other")))


def free_prefix(columns: list[str]) -> str:
    """Two underscores, or more where names in `columns` begin like one of ours."""
    own, prefix = (*MARGINS, "tokens", "prob", "residual", "kept", "words"), "__"
    while {f"{prefix}{c}" for c in own} & {c.lower() for c in columns}:
        prefix += "_"
    return prefix


def described(docs: DataFrame, terms: list[str], prefix: str) -> DataFrame:
    """docs with source, lang, topic and tokens under the prefix; a null source or language is its own value, the empty string."""
    w = F.col(f"{prefix}words")
    inside = lambda k: F.element_at(w, k) != ""
    d = docs.withColumn(f"{prefix}words", words(F.col("text")))
    n = F.size(w) - F.when(inside(1), 0).otherwise(1) - F.when((F.size(w) == 1) | inside(-1), 0).otherwise(1)
    d = d.withColumns({f"{prefix}tokens": n.cast("long"), f"{prefix}source": F.coalesce("source", F.lit("")), f"{prefix}lang": F.coalesce("lang", F.lit(""))})
    return d.withColumn(f"{prefix}topic", topic(w, F.col(f"{prefix}tokens"), terms)).drop(f"{prefix}words")


def _level(df: DataFrame, size: str, weight: Column, goal: float) -> DataFrame:
    """Adds `a`, the factor for which sum(min(size, a * weight)) is `goal` (the sum of sizes at most), 0 without weights. Rows that
    get all they have come first in order of weight by size; the factor is the largest of those that each row would have,
    were all before it held. Rows are values or cells."""
    every, order = Window.partitionBy(F.lit(0)), [c for c in MARGINS if c in df.columns]
    df = df.withColumn("__w", weight).withColumn("__key", F.when(F.col(size) > 0, F.col("__w") / F.col(size)).otherwise(F.lit(0.0)))
    before = F.coalesce(F.sum(size).over(every.orderBy(F.desc("__key"), *map(F.desc, order)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("__w").over(every.orderBy("__key", *order).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("a", F.when(F.col("__w") > 0, (F.lit(goal) - before) / F.nullif(after, F.lit(0.0))))
    return df.withColumn("a", F.greatest(F.coalesce(F.max("a").over(every), F.lit(0.0)), F.lit(0.0))).drop("__w", "__key")


def goals(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], rate: float) -> DataFrame:
    """cells with goal_source, goal_lang and goal_topic. All margins share one budget: rate * all tokens, or less where the named
    values of a margin haven't so many. A named value gets its share of it, at most what it has; the rest goes to the others.
    The goals of margins that aren't named are those of the cells' tokens times each value's tokens to its power less one,
    scaled under the same cap; so without targets one set of cells meets all goals."""
    weights = {}
    for m, t in targets.items():
        pairs = [x for k, v in t.items() for x in (F.lit(k), F.lit(max(0.0, float(v))))]
        weights[m] = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(m)), F.lit(0.0)) if pairs else F.lit(0.0)
    masses = [F.coalesce(F.sum(F.when(w > 0, F.col("total"))), F.lit(0.0)) for w in weights.values()]
    budget = float(cells.agg(F.least(F.lit(float(rate)) * F.sum("total"), F.sum("total"), *masses)).first()[0] or 0.0)
    boost = F.lit(1.0)
    for m in MARGINS:
        cells = cells.join(cells.groupBy(m).agg(F.sum("total").alias(f"has_{m}")), m)
        if m not in weights:
            boost = boost * F.when(F.col(f"has_{m}") > 0, F.pow(f"has_{m}", F.lit(TEMPERS[m] - 1))).otherwise(F.lit(0.0))
    cells = _level(cut(cells), "total", F.col("total") * boost, budget).withColumn("g", F.least("total", F.col("a") * F.col("total") * boost))
    cells = cut(cells.drop("a"))
    for m in MARGINS:
        if m in weights:
            v = cells.groupBy(m).agg(F.first(f"has_{m}").alias("has")).withColumn("has", F.when(weights[m] > 0, F.col("has")).otherwise(F.lit(0.0)))
            v = _level(v, "has", weights[m], budget).select(m, F.least("has", F.col("a") * weights[m]).alias(f"goal_{m}"))
        else:
            v = cells.groupBy(m).agg(F.sum("g").alias(f"goal_{m}"))
        cells = cells.join(v, m)
    return cells.select(*MARGINS, "total", *(f"goal_{m}" for m in MARGINS))


def _factor(goal: Column, held: Column, free: Column) -> Column:
    """By what a value's cells are scaled: so that those under the cap make up what the capped ones leave; where these alone have
    too many tokens or none is under the cap, all are scaled."""
    every = held + free
    return F.when((free > 0) & (goal > held), (goal - held) / free).when(every > 0, goal / F.nullif(every, F.lit(0.0))).otherwise(F.lit(0.0))


def _off(goal: Column, got: Column) -> Column:
    return F.coalesce(F.abs(got / F.nullif(goal, F.lit(0.0)) - 1), F.lit(0.0))


def _raked_in_a_row(cells: DataFrame, sweeps: int, tolerance: float) -> DataFrame:
    """cells with q, by sweeps over arrays in one row: BROADCAST_CELLS cells at most."""
    number = cells.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*MARGINS)) - 1)
    row = number.groupBy().agg(F.array_sort(F.collect_list(F.struct("i", *cells.columns))).alias("c"))
    for m in MARGINS:
        groups = number.groupBy(m).agg(F.first(f"goal_{m}").alias("goal"), F.collect_list("i").alias("at"))
        groups = groups.withColumn("g", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(m)) - 1)
        of = groups.select(F.explode("at").alias("i"), "g").groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "g"))).alias(f"of_{m}"))
        groups = groups.groupBy().agg(F.array_sort(F.collect_list(F.struct("g", "goal", "at"))).alias(f"groups_{m}"))
        row = row.unionByName(of, allowMissingColumns=True).unionByName(groups, allowMissingColumns=True)
    row = row.agg(*(F.first(c, True).alias(c) for c in row.columns))  # each has a value in one row
    row = row.select("c", F.transform("c", lambda x: x["total"]).alias("t"), *(F.transform(f"of_{m}", lambda x: x["g"]).alias(f"of_{m}") for m in MARGINS), *(f"groups_{m}" for m in MARGINS))
    row = cut(row)
    t, zero = F.col("t"), F.lit(0.0)

    def sums(g: Column, q: Column) -> Column:
        return F.aggregate(
            g["at"],
            F.struct(zero.alias("held"), zero.alias("free")),
            lambda s, i: F.when(q[i] >= 1, F.struct((s["held"] + t[i]).alias("held"), s["free"].alias("free"))).otherwise(F.struct(s["held"].alias("held"), (s["free"] + t[i] * q[i]).alias("free"))),
        )

    def scaled(q: Column, m: str) -> Column:
        factors = F.transform(f"groups_{m}", lambda g: _let(sums(g, q), lambda s: _factor(g["goal"], s["held"], s["free"])))
        return _let(factors, lambda a: F.zip_with(q, F.col(f"of_{m}"), lambda x, j: x * a[j]))

    def off(q: Column) -> Column:
        each = lambda m: F.transform(f"groups_{m}", lambda g: _let(sums(g, q), lambda s: _off(g["goal"], s["held"] + s["free"])))
        return F.greatest(*(F.coalesce(F.array_max(each(m)), zero) for m in MARGINS))

    def state(q: Column) -> Column:
        return F.struct(q.alias("q"), off(q).alias("off"))

    def sweep(q: Column) -> Column:
        a, b, c = MARGINS
        return _let(scaled(q, a), lambda q1: _let(scaled(q1, b), lambda q2: _let(scaled(q2, c), state)))

    start = _let(F.transform("t", lambda _: F.lit(1.0)), state)
    last = F.aggregate(F.sequence(F.lit(1), F.lit(sweeps)), start, lambda s, _: F.when(s["off"] <= tolerance, s).otherwise(sweep(s["q"])), lambda s: s["q"])
    return row.select(F.explode(F.arrays_zip(F.col("c"), last.alias("q"))).alias("x")).select(*(F.col(f"x.c.{c}").alias(c) for c in cells.columns), "x.q")


def _raked_by_shuffles(cells: DataFrame, sweeps: int, tolerance: float) -> DataFrame:
    """The same, for cells of any number: a shuffle by each margin in turn."""
    cells = cut(cells.withColumn("q", F.lit(1.0)))
    for done in range(sweeps):
        if (cells.agg(F.max("off")).first()[0] or 0.0) <= tolerance if done else False:
            break
        for m in MARGINS:
            held = F.sum(F.when(F.col("q") >= 1, F.col("total")).otherwise(0.0))
            free = F.sum(F.when(F.col("q") < 1, F.col("total") * F.col("q")).otherwise(0.0))
            factors = cells.groupBy(m).agg(_factor(F.first(f"goal_{m}"), held, free).alias("a"))
            cells = cells.join(factors, m).withColumn("q", F.col("q") * F.col("a")).drop("a")
        cells = cut(_with_residual(cells.drop("off")).withColumnRenamed("residual", "off"))
    return cells.drop("off")


def _with_residual(cells: DataFrame) -> DataFrame:
    for m in MARGINS:
        off = _off(F.first(f"goal_{m}"), F.sum(F.col("total") * F.least("q", F.lit(1.0))))
        cells = cells.join(cells.groupBy(m).agg(off.alias(f"off_{m}")), m)
    return cells.withColumn("residual", F.greatest(*(f"off_{m}" for m in MARGINS))).drop(*(f"off_{m}" for m in MARGINS))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, rate: float = RATE, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells(source, lang, topic, total) with prob, the cell's raked tokens over its tokens; goal_source, goal_lang, goal_topic;
    and residual: of the cell's three margins the largest distance from the goal, as a share of it.

    targets: for a margin, weights of its values (values that aren't named get none); margins that aren't named are
    tempered. The residual is at most `tolerance` where one set of cells can meet all goals; where the goals contradict each
    other, sweeps end after `sweeps`, and the residual says by how much the last fit misses. A cell without tokens has
    probability 1: its documents weigh nothing. No cells give no rows.
    """
    cells = cut(goals(cells.select(*MARGINS, F.col("total").cast("double").alias("total")), targets or {}, rate))
    raked = (_raked_in_a_row if cells.count() <= BROADCAST_CELLS else _raked_by_shuffles)(cells, sweeps, tolerance)
    prob = F.when(F.col("total") > 0, F.least("q", F.lit(1.0))).otherwise(F.lit(1.0))
    return _with_residual(cut(raked)).select(*MARGINS, "total", prob.alias("prob"), *(f"goal_{m}" for m in MARGINS), "residual")


def _drawn(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the id, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, rate: float = RATE, sweeps: int = SWEEPS, seed: int = SEED) -> DataFrame:
    """docs with __source, __lang, __topic, __tokens, __prob, __residual and __kept (see rake).

    A row is kept if the number that its id draws is below its cell's probability, so repeated ids share their fate and a
    null id draws like another. Null or empty texts have no tokens and the topic `empty`; their cell, without tokens, is
    kept whole. Columns of other names pass through; where docs has names like those above, ours begin with more
    underscores (free_prefix). Repeated rows each weigh. An empty table gives no rows.
    """
    p = free_prefix(docs.columns)
    names = [f"{p}{m}" for m in MARGINS]
    d = described(docs, topics(docs), p)
    cells = cut(d.groupBy(*names).agg(F.sum(f"{p}tokens").alias("total")).withColumnsRenamed(dict(zip(names, MARGINS, strict=True))))
    few = cells.count() <= BROADCAST_CELLS
    fitted = rake(cells, targets, rate, sweeps).select(*(F.col(m).alias(n) for m, n in zip(MARGINS, names, strict=True)), F.col("prob").alias(f"{p}prob"), F.col("residual").alias(f"{p}residual"))
    d = d.join(F.broadcast(fitted) if few else fitted, names).select(*docs.columns, *names, *(f"{p}{c}" for c in ("tokens", "prob", "residual")))
    return d.withColumn(f"{p}kept", _drawn(F.col("doc_id"), seed) < F.col(f"{p}prob"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that the mixture keeps."""
    return mix(docs, **options).where(f"{free_prefix(docs.columns)}kept").select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d, p = mix(docs), free_prefix(docs.columns)
    c = lambda name: F.col(f"{p}{name}")
    return d.select("doc_id", c("source").alias("source"), c("lang").alias("lang"), c("topic").alias("topic"), c("tokens").alias("n_tokens"), F.round(c("prob"), 6).alias("prob"), F.round(c("residual"), 6).alias("residual"), c("kept").alias("kept"))


def mixing_sql(documents: str = "documents") -> str:
    """DuckDB's form of op1_mixing over a relation with the columns of documents, as the body of WITH and a last relation m_k.
    It always makes SWEEPS sweeps, a recursion step a margin; those after all margins are met change nothing."""
    at = dict(zip(MARGINS, ("s_", "l_", "o_"), strict=True))
    pick = lambda x: f"CASE k % 3 WHEN 0 THEN {x.format('s_')} WHEN 1 THEN {x.format('l_')} ELSE {x.format('o_')} END"
    ctes = [
        f"m_d AS MATERIALIZED (SELECT *, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w_, coalesce(source, '') AS s_, coalesce(lang, '') AS l_ FROM {documents})",
        f"m_w AS MATERIALIZED (SELECT doc_id, substr(w, 1, {TERM}) AS term, count(*) AS n FROM m_d, unnest(w_) AS t(w) WHERE length(w) > {TERM} GROUP BY ALL)",
        f"m_a AS MATERIALIZED (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS r FROM m_w GROUP BY term HAVING count(*) * {RARE} <= (SELECT count(*) FROM m_d) ORDER BY r LIMIT {TOPICS})",
        "m_b AS MATERIALIZED (SELECT doc_id, arg_max(term, n * 1000 - r) AS term FROM m_w JOIN m_a USING (term) GROUP BY doc_id)",
        "m_t AS MATERIALIZED (SELECT m_d.*, len(w_) AS n_tokens, CASE WHEN len(w_) = 0 THEN 'empty' ELSE coalesce(term, 'other') END AS o_ FROM m_d LEFT JOIN m_b USING (doc_id))",
        "m_c AS MATERIALIZED (SELECT s_, l_, o_, cast(sum(n_tokens) AS DOUBLE) AS total FROM m_t GROUP BY ALL)",
    ]
    has = [f"sum(total) OVER (PARTITION BY {at[m]})" for m in MARGINS]
    boost = " * ".join(f"(CASE WHEN {h} > 0 THEN pow({h}, {TEMPERS[m] - 1}) ELSE 0 END)" for m, h in zip(MARGINS, has, strict=True))
    ctes += [
        f"m_f AS MATERIALIZED (SELECT *, {boost} AS f FROM m_c)",
        f"m_l AS (SELECT *, coalesce(sum(total) OVER (ORDER BY CASE WHEN total > 0 THEN f ELSE 0 END DESC, s_ DESC, l_ DESC, o_ DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(total * f) OVER (ORDER BY CASE WHEN total > 0 THEN f ELSE 0 END, s_, l_, o_ ROWS UNBOUNDED PRECEDING) AS after FROM m_f)",
        f"m_z AS MATERIALIZED (SELECT *, least(total, total * f * (SELECT max(({RATE} * (SELECT sum(total) FROM m_c) - before) / nullif(after, 0)) FROM m_l WHERE total * f > 0)) AS g FROM m_f)",
    ]
    ctes += [f"m_g{m} AS (SELECT {at[m]}, sum(g) AS g_{m} FROM m_z GROUP BY {at[m]})" for m in MARGINS]
    each, goal = pick("{0}"), "CASE k % 3 WHEN 0 THEN g_source WHEN 1 THEN g_lang ELSE g_topic END"
    keys = "s_, l_, o_"
    ctes.append(f"""m_r AS (SELECT 0 AS k, s_, l_, o_, total, g_source, g_lang, g_topic, cast(1 AS DOUBLE) AS q FROM m_c JOIN m_gsource USING (s_) JOIN m_glang USING (l_) JOIN m_gtopic USING (o_)
UNION ALL SELECT k + 1, s_, l_, o_, total, g_source, g_lang, g_topic, q * CASE WHEN free > 0 AND g > held THEN (g - held) / free WHEN held + free > 0 THEN g / (held + free) ELSE 0 END FROM (
  SELECT *, {goal} AS g, sum(CASE WHEN q >= 1 THEN total ELSE 0 END) OVER (PARTITION BY {each}) AS held, sum(CASE WHEN q < 1 THEN total * q ELSE 0 END) OVER (PARTITION BY {each}) AS free FROM m_r WHERE k < {3 * SWEEPS}))""")
    off = [f"coalesce(abs(sum(total * least(q, 1)) OVER (PARTITION BY {at[m]}) / nullif(g_{m}, 0) - 1), 0)" for m in MARGINS]
    ctes.append(f"m_p AS MATERIALIZED (SELECT {keys}, CASE WHEN total > 0 THEN least(q, 1) ELSE 1 END AS prob, greatest({', '.join(off)}) AS residual FROM m_r WHERE k = {3 * SWEEPS})")
    ctes.append(f"m_k AS MATERIALIZED (SELECT m_t.*, prob, residual, cast('0x' || substr(md5('{SEED}|' || coalesce(cast(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / {1 << 52}.0 < prob AS kept FROM m_t JOIN m_p USING ({keys}))")
    return ",\n".join(ctes)


OP1_SQL = f"WITH RECURSIVE {mixing_sql()}\nSELECT doc_id, s_ AS source, l_ AS lang, o_ AS topic, cast(n_tokens AS BIGINT) AS n_tokens, round(prob, 6) AS prob, round(residual, 6) AS residual, kept FROM m_k"
