"""Motifs and recurrence inside episodes, with their null draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.functions.scalars import N_JOINT, motif_text, rounded
from dyadflow.operators import motifs, nulls, recurrence
from dyadflow.operators.sequence import in_episodes
from dyadflow.plans.registry import query
from dyadflow.plans.steps import EPISODES, r6, regimes

EP = ("episode",)
#: As many draws as the analyses make.
RQA_DRAWS, MOTIF_DRAWS, SEED, MIN_DURATION = 100, 200, 7, 15


def episode_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = in_episodes(regimes(spark, sf_dir), 5)
    return d.withColumn("episode", F.concat_ws("_", *(F.col(c).cast("string") for c in ("session_id", "regime", "start", "end"))))


def _ids(k: int, source: str = "eps", by: str = "episode", name: str = "m") -> str:
    number = " + ".join(f"{N_JOINT ** (k - 1 - i)} * lead(x, {i}) OVER w" for i in range(k))
    return f"{name} AS (SELECT * FROM (SELECT {by}, q, cast({number} AS BIGINT) AS motif FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY q)) WHERE motif IS NOT NULL)"


def _text(k: int, m: str = "motif") -> str:
    return " || '-' || ".join(f"cast(({m} // {N_JOINT ** (k - 1 - i)}) % {N_JOINT} AS VARCHAR)" for i in range(k))


def _metrics(k: int, by: str = "episode", name: str = "m", out: str = "met") -> str:
    return f"""{out}_c AS (SELECT {by}, motif, count(*) AS n FROM {name} GROUP BY ALL),
{out}_r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, motif) AS r, sum(n) OVER (PARTITION BY {by}) AS t FROM {out}_c),
{out}_1 AS (SELECT {by}, cast(sum(n) AS BIGINT) AS n_windows, count(*) AS n_unique, greatest(ln(sum(n)) - sum(n * ln(n)) / sum(n), 0) AS motif_entropy, sum(n / t) FILTER (WHERE r <= 5) AS top_mass, max(motif) FILTER (WHERE r = 1) AS top, max(n / t) FILTER (WHERE r = 1) AS top_motif_prob FROM {out}_r GROUP BY ALL),
{out}_p AS (SELECT {by}, motif, nxt, count(*) AS n FROM (SELECT {by}, motif, lead(motif) OVER (PARTITION BY {by} ORDER BY q) AS nxt FROM {name}) WHERE nxt IS NOT NULL GROUP BY ALL),
{out}_2 AS (SELECT {by}, coalesce(sum(n) FILTER (WHERE motif = nxt), 0) / sum(n) AS repeat_rate, greatest(ln(sum(n)) - sum(n * ln(n)) / sum(n), 0) AS transition_entropy, count(*) AS kinds FROM {out}_p GROUP BY ALL),
{out} AS (SELECT {out}_1.*, exp(motif_entropy) AS effective_motif_count, coalesce(repeat_rate, 0) AS repeat_rate, coalesce(transition_entropy, 0) AS transition_entropy, CASE WHEN kinds > 1 THEN transition_entropy / ln(kinds) ELSE 0 END AS motif_transition_diversity FROM {out}_1 LEFT JOIN {out}_2 USING ({by}))"""


@query(f"WITH {EPISODES}, {_ids(2)} SELECT episode, motif, {_text(2)} AS motif_text, count(*) AS n FROM m GROUP BY ALL")
def motif_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = motifs.motif_ids(episode_steps(spark, sf_dir), 2, EP)
    return d.groupBy("episode", "motif").agg(F.count("*").alias("n")).withColumn("motif_text", motif_text(F.col("motif"), 2))


def _metrics_query(k: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = motifs.motif_metrics(motifs.motif_ids(episode_steps(spark, sf_dir), k, EP), k, EP)
        return d.select("episode", "n_windows", "n_unique", "top_motif", *(rounded(F.col(c)).alias(c) for c in (*motifs.METRICS, "transition_entropy", "top_motif_prob")))

    run.__name__ = f"motif_metrics_k{k}"
    cols = ", ".join(f"{r6(c)} AS {c}" for c in (*motifs.METRICS, "transition_entropy", "top_motif_prob"))
    return query(f"WITH {EPISODES}, {_ids(k)}, {_metrics(k)} SELECT episode, n_windows, n_unique, {_text(k, 'top')} AS top_motif, {cols} FROM met")(run)


motif_metrics_k2, motif_metrics_k3 = _metrics_query(2), _metrics_query(3)


@query(f"WITH {EPISODES}, {_ids(2)}, {_metrics(2)} SELECT episode, cast(r AS INT) AS rank, {_text(2)} AS motif, {r6('n / t')} AS prob FROM met_r WHERE r <= 5")
def top_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each episode's five commonest motifs, out of the JSON that motif_metrics() makes."""
    d = motifs.motif_metrics(motifs.motif_ids(episode_steps(spark, sf_dir), 2, EP), 2, EP)
    d = d.select("episode", F.posexplode(F.from_json("top_motifs", "array<struct<motif: string, prob: double>>")).alias("rank", "m"))
    return d.select("episode", (F.col("rank") + 1).alias("rank"), "m.motif", rounded(F.col("m.prob")).alias("prob"))


def _rqa(by: str, source: str = "eps", out: str = "rqa", w: int = 1, lmin: int = 2, v: int = 2) -> str:
    return f"""{out}_p AS (SELECT {", ".join(f"a.{c.strip()}" for c in by.split(","))}, a.q AS i, b.q AS j FROM {source} AS a JOIN {source} AS b ON {" AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in by.split(","))} AND a.x = b.x WHERE abs(a.q - b.q) > {w}),
{out}_g AS (SELECT *, i - row_number() OVER (PARTITION BY {by}, j - i ORDER BY i) AS g, i - row_number() OVER (PARTITION BY {by}, j ORDER BY i) AS h FROM {out}_p),
{out}_l AS (SELECT *, count(*) OVER (PARTITION BY {by}, j - i, g) AS dl, count(*) OVER (PARTITION BY {by}, j, h) AS vl FROM {out}_g),
{out}_f AS (SELECT {by}, count(*) AS rec, count(*) FILTER (WHERE dl >= {lmin}) AS d, count(*) FILTER (WHERE vl >= {v}) AS l FROM {out}_l GROUP BY ALL),
{out}_n AS (SELECT {by}, count(*) AS n, greatest(count(*) - {w} - 1, 0) * (greatest(count(*) - {w} - 1, 0) + 1) AS e FROM {source} GROUP BY ALL),
{out} AS (SELECT {by}, n, coalesce(rec / nullif(e, 0), 0) AS rr, coalesce(d / rec, 0) AS det, coalesce(l / rec, 0) AS lam FROM {out}_n LEFT JOIN {out}_f USING ({by}))"""


_RQA_COLS = ", ".join(f"{r6(c)} AS {c}" for c in ("rr", "det", "lam"))


def _rounded(d: DataFrame) -> DataFrame:
    return d.select(*(rounded(F.col(c)).alias(c) if t == "double" else c for c, t in d.dtypes))


@query(f"WITH {EPISODES}, {_rqa('episode')} SELECT episode, n, {_RQA_COLS} FROM rqa")
def rqa_rr_det_lam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(recurrence.recurrence(episode_steps(spark, sf_dir), EP))


@query(f"WITH {EPISODES}, {_rqa('episode', w=2, lmin=3, v=3)} SELECT episode, n, {_RQA_COLS} FROM rqa")
def rqa_by_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(recurrence.recurrence_by_sequence(episode_steps(spark, sf_dir), EP, theiler=2, l_min=3, v_min=3))


def _shuffled(draws: int) -> str:
    return f"""long_eps AS (SELECT * FROM eps WHERE duration >= {MIN_DURATION}),
sh AS (SELECT episode, draw, row_number() OVER (PARTITION BY episode, draw ORDER BY md5('{SEED}|' || episode || '|' || draw || '|' || q), q) - 1 AS q, x FROM long_eps, unnest(range({draws})) AS t(draw))"""


def _against(v: str, null: str, name: str) -> str:
    return f"""{r6(f"CASE WHEN stddev_pop({null}) > 1e-12 THEN (any_value({v}) - avg({null})) / stddev_pop({null}) ELSE 0 END")} AS {name}_z_shuffle,
{r6(f"(1 + count(*) FILTER (WHERE {null} >= {v})) / (count(*) + 1)")} AS {name}_p_hi_shuffle, {r6(f"(1 + count(*) FILTER (WHERE {null} <= {v})) / (count(*) + 1)")} AS {name}_p_lo_shuffle,
{r6(f"least(1, 2 * least(1 + count(*) FILTER (WHERE {null} >= {v}), 1 + count(*) FILTER (WHERE {null} <= {v})) / (count(*) + 1))")} AS {name}_p_two_shuffle"""


@query(f"""WITH {EPISODES}, {_shuffled(RQA_DRAWS)}, {_rqa('episode', 'long_eps', 'obs')}, {_rqa('episode, draw', 'sh', 'nul')}
SELECT o.episode, any_value(o.n) AS n, {", ".join(f"{r6(f'any_value(o.{m})')} AS {m}, {_against(f'round(o.{m}, 9)', f'round(u.{m}, 9)', m)}" for m in ("rr", "det", "lam"))}
FROM obs AS o JOIN nul AS u USING (episode) GROUP BY o.episode""")
def rqa_shuffle_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = episode_steps(spark, sf_dir).where(F.col("duration") >= MIN_DURATION)
    nine = lambda x: x.withColumns({m: F.round(m, 9) for m in ("rr", "det", "lam")})
    observed = nine(recurrence.recurrence(d, EP))
    draws = nine(recurrence.recurrence_by_sequence(nulls.shuffled(d, EP, RQA_DRAWS, seed=SEED), (*EP, "draw")))
    return _rounded(nulls.compared(observed, draws, EP, ("rr", "det", "lam"), "shuffle"))


_NULL_METRICS = motifs.METRICS


@query(f"""WITH {EPISODES}, {_shuffled(MOTIF_DRAWS)}, {_ids(2, 'long_eps')}, {_metrics(2)}, shk AS (SELECT episode || '#' || draw AS episode, q, x FROM sh), {_ids(2, 'shk', name='mm')}, {_metrics(2, name='mm', out='nul')}
SELECT met.episode, {", ".join(f"{r6(f'any_value(met.{m})')} AS {m}, {_against(f'round(met.{m}, 9)', f'round(nul.{m}, 9)', m)}" for m in _NULL_METRICS)}
FROM met JOIN nul ON met.episode = split_part(nul.episode, '#', 1) GROUP BY met.episode""")
def motif_shuffle_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = episode_steps(spark, sf_dir).where(F.col("duration") >= MIN_DURATION)
    return _rounded(nulls.motifs_against_shuffles(d, EP, 2, MOTIF_DRAWS, seed=SEED).where("motif_entropy_p_hi_shuffle is not null"))


@query()
def motif_markov_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = episode_steps(spark, sf_dir).where(F.col("duration") >= MIN_DURATION)
    observed = motifs.motif_metrics(motifs.motif_ids(d, 2, EP), 2, EP).select("episode", "n_windows", *motifs.METRICS)
    by = (*EP, "draw")
    draws = motifs.motif_metrics(motifs.motif_ids(nulls.markov_surrogates(d, EP, MOTIF_DRAWS, seed=SEED), 2, by), 2, by)
    return _rounded(nulls.compared(observed, draws, EP, motifs.METRICS, "markov"))
