"""Conversations as episodes: a user's turn is a query, the answer the ranking that it finds."""

from pyspark.sql import functions as F

from orrery.functions.text import context_tokens
from orrery.operators import episodes as ep
from orrery.operators.retrieval import ranked
from orrery.operators.symbolic import feedback
from orrery.plans.metrics import CTX
from orrery.plans.registry import query
from orrery.session import staged, table

BUDGET = 4
SETTINGS = [
    ep.Settings("default"), ep.Settings("short", budget=2), ep.Settings("gated", gate=True, threshold=0.9), ep.Settings("patient", gate=True, threshold=0.93, rejections=2, alpha=0.8),
]

#: Rounds q(episode, round, ts, ans), their dimensions' states d and logs g(episode, round, slate rows) as the queries below make them.
LOG = f"""u AS (SELECT conv_id AS episode, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS round, {CTX} AS ts FROM conversations WHERE role = 'user' QUALIFY round <= {BUDGET}),
    q AS (SELECT u.episode, round, ts, a.text AS ans FROM u LEFT JOIN conversations a ON a.conv_id = u.episode AND a.turn = u.turn + 1 AND a.role = 'assistant'),
    al AS (SELECT episode, round, tok AS tag, min(pos) AS pos FROM (SELECT episode, round, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM (SELECT episode, round, regexp_extract_all(lower(coalesce(ans, '')), '[a-z0-9]+(?:\\.[0-9]+)?') AS w FROM q)) GROUP BY ALL),
    li AS (SELECT episode, round, tag, row_number() OVER (PARTITION BY episode, round ORDER BY pos) AS rank FROM al),
    qt AS (SELECT episode, round, unnest(ts) AS tok FROM q),
    ql AS (SELECT episode, round, tok AS tag, row_number() OVER (PARTITION BY episode, round ORDER BY length(tok) DESC, tok) AS rank FROM qt),
    di AS (SELECT * FROM (VALUES (0, 'FAMILY'), (1, 'ROLE'), (2, 'EVENT'), (3, 'QUALIFIER'), (4, 'SCOPE'), (5, 'TEMPORAL')) t(k, dimension)),
    ve AS (SELECT t.episode, t.round, ascii(tok) % 6 AS k, li.tag IS NOT NULL AS v FROM qt t LEFT JOIN li ON li.episode = t.episode AND li.round = t.round AND li.tag = tok),
    d AS (SELECT q.episode, q.round, di.k, dimension, s, CASE WHEN s >= 0.6 THEN 'supported' WHEN s <= 0.25 THEN 'contradicted' ELSE 'unresolved' END AS state
          FROM q, di LEFT JOIN (SELECT episode, round, k, avg(v::INT::DOUBLE) AS s FROM ve GROUP BY ALL) x ON x.episode = q.episode AND x.round = q.round AND x.k = di.k),
    fb AS (SELECT episode, round + 1 AS round, count(*) FILTER (state = 'contradicted' AND k < 3) >= 2 AS mismatch FROM d GROUP BY ALL),
    pr AS (SELECT episode, round + 1 AS round, CASE state WHEN 'contradicted' THEN 1 ELSE 3 END AS p, k, CASE state WHEN 'contradicted' THEN 'REFINE' ELSE 'BRANCH' END AS mode, 'O_refine_' || lower(dimension) AS operator, 1 - coalesce(s, 0.5) AS score FROM d WHERE state <> 'supported'
           UNION ALL SELECT episode, round, 2, 0, 'CHANGE_STRATEGY', 'O_change_strategy', 0 FROM fb WHERE mismatch UNION ALL SELECT episode, round, 4, 0, 'PERTURB', 'O_perturb', 0 FROM fb),
    sl AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY episode, round) AS n FROM pr WINDOW w AS (PARTITION BY episode, round ORDER BY p, k)),
    kept AS (SELECT *, row_number() OVER (PARTITION BY episode, round ORDER BY score DESC, p, i) AS choice FROM sl WHERE n <= 6 OR i < 6 OR p = 4),
    sel AS (SELECT episode, round, count(*) AS slate, max(operator) FILTER (choice = 1) AS selected, max(operator) FILTER (choice = 2) AS runner_up FROM kept GROUP BY ALL),
    go AS (SELECT episode, tok AS tag FROM qt WHERE round = 1 AND length(tok) >= 6),
    la AS (SELECT episode, max(round) AS last FROM q GROUP BY 1),
    sp AS (SELECT li.*, la.last, unnest(range(li.round, la.last + 1)) AS upto FROM li JOIN la USING (episode)),
    fu AS (SELECT episode, upto, which, tag, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(rank) AS best FROM (
           SELECT episode, upto, 'after' AS which, tag, rank FROM sp UNION ALL SELECT episode, upto, 'replay', tag, rank FROM sp WHERE upto > round UNION ALL SELECT episode, round, 'replay', tag, rank FROM ql) GROUP BY ALL),
    ra AS (SELECT episode, upto, which, tag, row_number() OVER (PARTITION BY episode, upto, which ORDER BY round(rrf, 12) DESC, best, tag) AS rank FROM fu),
    hi AS (SELECT episode, upto AS round, min(rank) FILTER (which = 'after') AS rank_after, min(rank) FILTER (which = 'replay') AS rank_replay FROM ra JOIN go USING (episode, tag) GROUP BY ALL),
    nv AS (SELECT a.episode, a.round, round(1 - max(len(list_intersect(a.ts, b.ts)) / greatest(len(list_distinct(list_concat(a.ts, b.ts))), 1)), 6) AS m FROM q a JOIN q b ON a.episode = b.episode AND b.round < a.round GROUP BY ALL),
    g AS (SELECT q.episode, q.round, CASE WHEN len(q.ts) = 0 THEN 1 ELSE coalesce(m, 1) END AS novelty, coalesce(slate, 0) AS slate, selected, runner_up, runner_up IS NOT NULL AS replayed, q.ans IS NOT NULL AS parsed, rank_after, rank_replay,
          CASE WHEN rank_after IS NULL THEN 0 ELSE 1 / log2(rank_after + 1) END AS ua, CASE WHEN rank_replay IS NULL THEN 0 ELSE 1 / log2(rank_replay + 1) END AS ur
          FROM q LEFT JOIN nv USING (episode, round) LEFT JOIN sel USING (episode, round) LEFT JOIN hi USING (episode, round)),
    st AS (SELECT * FROM (VALUES {", ".join(f"('{s.name}', {s.budget}, {str(s.gate).lower()}, {s.threshold}, {s.rejections}, {s.alpha})" for s in SETTINGS)}) t(setting, budget, gate, threshold, rejections, alpha)),
    run AS (SELECT setting, budget, gate, threshold::DOUBLE AS threshold, rejections, alpha::DOUBLE AS alpha, episode, 1 AS round, 0 AS rejected, '' AS stop, ua, NULL::DOUBLE AS gain, NULL::DOUBLE AS contrast FROM g, st WHERE round = 1
            UNION ALL SELECT setting, budget, gate, threshold, rejections, alpha, r.episode, r.round + 1, x.n,
              CASE WHEN r.round + 1 > budget THEN 'budget_exhausted' WHEN g.episode IS NULL THEN 'log_ended' WHEN g.slate = 0 THEN 'no_admissible_directive' WHEN NOT g.parsed THEN 'revision_parse_failed' WHEN x.low AND x.n >= rejections THEN 'novelty_gate_exhaustion' ELSE '' END,
              g.ua, g.ua - r.ua, g.ua - CASE WHEN g.replayed THEN g.ur ELSE r.ua END
            FROM run r LEFT JOIN g ON g.episode = r.episode AND g.round = r.round + 1,
              LATERAL (SELECT coalesce(r.round + 1 <= budget AND g.slate > 0 AND g.parsed AND gate AND g.novelty < threshold, false) AS low, r.rejected + coalesce(r.round + 1 <= budget AND g.slate > 0 AND g.parsed AND gate AND g.novelty < threshold, false)::INT AS n) x
            WHERE r.stop = ''),
    done AS (SELECT *, alpha * gain + (1 - alpha) * contrast AS reward FROM run WHERE stop = ''),
    why AS (SELECT setting, episode, stop FROM run WHERE stop <> '')"""


def rounds(spark, sf_dir):
    """The log of all conversations: of the first queries and answers the feedback, the directives that it admits, and the gold ranks of what was found."""
    talk = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode"), "turn", "role", "text")
    asked = ranked(talk.where("role = 'user'"), ["episode"], [F.col("turn")], BUDGET).select("episode", F.col("rank").alias("round"), (F.col("turn") + 1).alias("turn"), context_tokens(F.col("text")).alias("query"))
    answers = talk.where("role = 'assistant'").select("episode", "turn", F.col("text").alias("answer"))
    log = staged(asked.join(answers, ["episode", "turn"], "left").select("episode", "round", "query", F.col("answer").isNotNull().alias("parsed"), context_tokens(F.col("answer")).alias("found")), "rounds")
    lists = log.select("episode", "round", F.posexplode("found").alias("rank", "tag")).withColumn("rank", F.col("rank") + 1)
    word = log.select("episode", "round", "found", F.explode("query").alias("tag"))
    replays = ranked(word.select("episode", "round", "tag"), ["episode", "round"], [F.desc(F.length("tag")), F.col("tag")])
    gold = word.where((F.col("round") == 1) & (F.length("tag") >= 6)).select("episode", F.col("tag").alias("gold"))
    dimension = F.get(F.array(*[F.lit(d) for d in ep.DIMENSIONS]), F.ascii("tag") % 6)
    judged = feedback(word.withColumn("dimension", dimension).withColumn("verdict", F.array_contains("found", F.col("tag"))), ["episode", "round"])
    at = lambda state: F.collect_list(F.when(F.col("state") == state, F.col("dimension")))
    told = judged.groupBy("episode", "round").agg(at("supported").alias("supported"), at("contradicted").alias("contradicted"), F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit(ep.REFINE_PREFIX), F.lower("dimension")), 1 - F.col("support")))).alias("scores"))
    every = F.array(*[F.lit(d) for d in ep.DIMENSIONS])
    told = log.select("episode", "round").join(told, ["episode", "round"], "left").select("episode", (F.col("round") + 1).alias("round"), *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("supported", "contradicted")], "scores")
    told = told.withColumn("unresolved", F.array_except(every, F.concat("supported", "contradicted")))
    none = {f"{ep.REFINE_PREFIX}{d.lower()}": 0.5 for d in ep.DIMENSIONS}
    half = F.create_map(*[F.lit(x) for kv in none.items() for x in kv])
    scores = F.when(F.col("scores").isNull(), half).otherwise(F.map_concat("scores", F.map_filter(half, lambda k, _: ~F.map_contains_key("scores", k))))
    structural = F.size(F.array_intersect("contradicted", F.array(*[F.lit(d) for d in ep.DIMENSIONS[:3]]))) >= 2
    slates = told.withColumn("slate", ep.slate(F.col("contradicted"), F.col("unresolved"), structural)).withColumn("_scores", scores)
    best, rest = ep.choose(F.col("slate"), F.col("_scores"))
    slates = slates.select("episode", "round", "slate", best["operator"].alias("selected"), rest["operator"].alias("runner_up"))
    ranks = ep.prefix_ranks(lists, gold, replays)
    rows = log.select("episode", "round", "query", "parsed").join(slates, ["episode", "round"], "left").join(ranks, ["episode", "round"], "left")
    return rows.withColumn("slate", F.coalesce("slate", F.array().cast(slates.schema["slate"].dataType))).withColumn("replayed", F.col("runner_up").isNotNull())


@query(
    f"""WITH RECURSIVE {LOG} SELECT setting, d.episode, d.round::BIGINT AS round, g.selected, g.runner_up, round(g.novelty, 6) AS novelty, d.rejected::BIGINT AS rejected, w.stop AS stop_reason, g.rank_after, round(d.gain, 6) AS gain, round(d.contrast, 6) AS contrast, round(d.reward, 6) AS reward
    FROM done d JOIN why w USING (setting, episode) JOIN g ON g.episode = d.episode AND g.round = d.round"""
)
def episode_rounds(spark, sf_dir):
    """What each setting's controller would have realized of the logged rounds, with their delayed rewards."""
    out = ep.replay(rounds(spark, sf_dir), SETTINGS)
    return out.select("setting", "episode", F.col("round").cast("long").alias("round"), "selected", "runner_up", F.round("novelty", 6).alias("novelty"), "rejected", "stop_reason", "rank_after", *[F.round(c, 6).alias(c) for c in ("gain", "contrast", "reward")])


@query(
    f"""WITH RECURSIVE {LOG} SELECT setting, d.episode, any_value(w.stop) AS stop_reason, max(d.round)::BIGINT AS rounds, max(d.rejected)::BIGINT AS rejected, round(coalesce(sum(d.reward), 0), 6) AS reward, max_by(coalesce(g.rank_after, 0), d.round) AS rank, round(max_by(g.ua, d.round), 6) AS utility
    FROM done d JOIN why w USING (setting, episode) JOIN g ON g.episode = d.episode AND g.round = d.round GROUP BY setting, d.episode"""
)
def episode_replay(spark, sf_dir):
    """Stop reason, reward and final rank of every episode under four settings."""
    out = ep.episodes(ep.replay(rounds(spark, sf_dir).withColumn("rank_after", F.coalesce("rank_after", F.lit(0))), SETTINGS))
    return out.select("setting", "episode", "stop_reason", F.col("rounds").cast("long").alias("rounds"), "rejected", F.round("reward", 6).alias("reward"), "rank", F.round("utility", 6).alias("utility"))
