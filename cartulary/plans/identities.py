"""Queries of identity corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.catalogue import corrections
from cartulary.operators.lineage import written
from cartulary.plans.registry import Tables, named

# Parts are cards, orders their customers' printings, events images, customers edges from a card to a printing.
_BASE = """
cards AS (SELECT 'c' || p_partkey AS id, 'g' || (p_partkey // 100 % 3) AS game, CASE WHEN p_size % 11 = 0 THEN 'art' ELSE 'gameplay' END AS category FROM part),
printings AS (SELECT 'p' || o_orderkey AS id, 'c' || o_custkey AS card_id, o_orderkey AS o, o_custkey AS k FROM orders),
splitting AS (SELECT k, map_from_entries(list((id, 'c' || (k + 1 + o % 2)))) AS given FROM printings WHERE k % 40 = 10 AND (k % 80 <> 50 OR o % 5 <> 0) GROUP BY k),
firsts AS (SELECT k, min(o) AS o FROM printings WHERE k % 40 = 10 GROUP BY k),
none AS (SELECT map_from_entries(CAST([] AS STRUCT(k VARCHAR, v VARCHAR)[])) AS m),
decisions AS (
  SELECT p_partkey AS sequence, 'merge' AS action, 'card' AS kind, game, ['c' || p_partkey] AS sources, ['c' || (p_partkey + 1)] AS targets, none.m AS assignments FROM part JOIN cards ON id = 'c' || p_partkey, none WHERE p_partkey % 40 = 0
  UNION ALL SELECT 1000000 + p_partkey, 'merge', 'card', game, ['c' || p_partkey], ['c' || (p_partkey + 2)], none.m FROM part JOIN cards ON id = 'c' || p_partkey, none WHERE p_partkey % 40 = 1
  UNION ALL SELECT p_partkey, 'split', 'card', game, ['c' || p_partkey], ['c' || (p_partkey + 1), 'c' || (p_partkey + 2)], coalesce(given, none.m) FROM part JOIN cards ON id = 'c' || p_partkey LEFT JOIN splitting s ON s.k = p_partkey, none WHERE p_partkey % 40 = 10
  UNION ALL SELECT p_partkey, 'merge', 'card', game, ['c' || p_partkey], ['c' || (p_partkey + 1), 'c' || (p_partkey + 2)], none.m FROM part JOIN cards ON id = 'c' || p_partkey, none WHERE p_partkey % 40 = 20
  UNION ALL SELECT p_partkey, 'merge', 'card', game, ['c' || p_partkey], ['c' || (p_partkey - 25)], none.m FROM part JOIN cards ON id = 'c' || p_partkey, none WHERE p_partkey % 40 = 25
  UNION ALL SELECT p_partkey, 'merge', 'printing', game, ['p' || p_partkey], ['p' || (p_partkey + 1)], none.m FROM part JOIN cards ON id = 'c' || p_partkey, none WHERE p_partkey % 40 = 30
  UNION ALL SELECT 2000000 + p_partkey, 'assign', 'card', game, ['c' || (p_partkey - 1)], ['c' || (p_partkey + 1)], map_from_entries([('p' || coalesce(f.o, 0), 'c' || (p_partkey + 1))]) FROM part JOIN cards ON id = 'c' || p_partkey LEFT JOIN firsts f ON f.k = p_partkey - 1 WHERE p_partkey % 40 = 11)
"""

_PROBLEMS = """
entities AS (
  SELECT 'card' AS kind, id, game AS its_game, NULL AS card_id, category FROM cards
  UNION ALL SELECT 'printing', p.id, c.game, p.card_id, NULL FROM printings p LEFT JOIN cards c ON c.id = p.card_id),
shaped AS (SELECT *, CASE action WHEN 'merge' THEN len(targets) = 1 WHEN 'split' THEN len(targets) >= 2 ELSE true END AS fine FROM decisions),
d AS (SELECT * FROM shaped WHERE fine),
named AS (SELECT sequence, action, kind, game, unnest(CASE WHEN action = 'assign' THEN targets ELSE list_concat(sources, targets) END) AS id FROM d),
known AS (SELECT n.*, e.its_game, e.card_id, e.category FROM named n LEFT JOIN entities e ON e.kind = n.kind AND e.id = n.id),
merged AS (SELECT sequence, kind, min(card_id) AS lo, max(card_id) AS hi, min(category) AS a, max(category) AS b FROM known WHERE action = 'merge' GROUP BY 1, 2),
first AS (SELECT kind, id, min(sequence) AS first FROM (SELECT kind, sequence, unnest(sources) AS id FROM d WHERE action <> 'assign') GROUP BY 1, 2),
given AS (SELECT sequence, action, kind, sources[1] AS source, targets, unnest(map_keys(assignments)) AS printing, unnest(map_values(assignments)) AS card FROM d),
before AS (SELECT DISTINCT sources[1] AS source, unnest(targets) AS target FROM d WHERE action = 'split' AND sequence % 80 <> 50),
problems AS (
  SELECT sequence, 'malformed' AS code, action AS subject FROM shaped WHERE NOT fine
  UNION SELECT sequence, 'unknown_entity', id FROM known WHERE its_game IS NULL
  UNION SELECT sequence, 'other_game', id FROM known WHERE its_game <> game
  UNION SELECT sequence, 'printings_of_several_cards', lo FROM merged WHERE kind = 'printing' AND lo <> hi
  UNION SELECT sequence, 'category_differs', a FROM merged WHERE kind = 'card' AND a <> b
  UNION SELECT n.sequence, 'retired_before', n.id FROM named n JOIN first f ON f.kind = n.kind AND f.id = n.id WHERE n.action <> 'assign' AND f.first < n.sequence
  UNION SELECT sequence, 'assigned_elsewhere', printing FROM given WHERE NOT list_contains(targets, card)
  UNION SELECT s.sequence, 'printing_unassigned', p.id FROM d s JOIN printings p ON p.card_id = s.sources[1] WHERE s.action = 'split' AND NOT EXISTS (SELECT 1 FROM given g WHERE g.sequence = s.sequence AND g.printing = p.id)
  UNION SELECT g.sequence, 'foreign_assignment', g.printing FROM given g WHERE g.action = 'split' AND NOT EXISTS (SELECT 1 FROM printings p WHERE p.id = g.printing AND p.card_id = g.source)
  UNION SELECT sequence, 'no_split', sources[1] FROM d WHERE action = 'assign' AND (sources[1], targets[1]) NOT IN (SELECT source, target FROM before))
"""


def _decisions(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("p_partkey")
    name = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    game = F.concat(F.lit("g"), F.expr("p_partkey div 100 % 3"))
    cards = t.part.select(name("c", k).alias("id"), game.alias("game"), F.when(F.col("p_size") % 11 == 0, "art").otherwise("gameplay").alias("category"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    printings = t.orders.select(name("p", o).alias("id"), name("c", c).alias("card_id"))
    splitting = t.orders.where((c % 40 == 10) & ((c % 80 != 50) | (o % 5 != 0))).groupBy(c.alias("k")).agg(F.map_from_entries(F.collect_list(F.struct(name("p", o), name("c", c + 1 + o % 2)))).alias("given"))
    firsts = t.orders.where(c % 40 == 10).groupBy((c + 1).alias("k")).agg(F.min(o).alias("o"))
    rows = t.part.select(k.alias("k"), game.alias("game")).join(splitting, "k", "left").join(firsts, "k", "left")
    x, none = F.col("k"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def one(at: int, action: str, sources, targets, kind: str = "card", given: Column = none, later: int = 0) -> DataFrame:
        ids = lambda xs: F.array(*[name("p" if kind == "printing" else "c", y) for y in xs])
        return rows.where(x % 40 == at).select((x + later).alias("sequence"), F.lit(action).alias("action"), F.lit(kind).alias("kind"), "game", ids(sources).alias("sources"), ids(targets).alias("targets"), given.alias("assignments"))

    parts = [
        one(0, "merge", [x], [x + 1]), one(1, "merge", [x], [x + 2], later=1_000_000), one(10, "split", [x], [x + 1, x + 2], given=F.coalesce("given", none)),
        one(20, "merge", [x], [x + 1, x + 2]), one(25, "merge", [x], [x - 25]), one(30, "merge", [x], [x + 1], "printing"),
        one(11, "assign", [x - 1], [x + 1], given=F.create_map(name("p", F.coalesce("o", F.lit(0))), name("c", x + 1)), later=2_000_000),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return written(every), cards, printings


def _retained(decisions: DataFrame) -> DataFrame:
    """The splits that stand as the history of the assignments."""
    return decisions.where("action = 'split' and sequence % 80 <> 50")


@named(f"WITH {_BASE.strip()}, {_PROBLEMS.strip()} SELECT * FROM problems")
def q_correction_problems(t: Tables) -> DataFrame:
    decisions, cards, printings = _decisions(t)
    return corrections.problems(decisions, _retained(decisions), cards, printings)


@named(f"""
WITH {_BASE.strip()}, {_PROBLEMS.strip()},
good AS (SELECT * FROM decisions WHERE sequence NOT IN (SELECT sequence FROM problems)),
gone AS (SELECT DISTINCT kind, unnest(sources) AS id FROM good WHERE action <> 'assign'),
merges AS (SELECT unnest(sources) AS now, targets[1] AS nxt FROM good WHERE kind = 'card' AND action = 'merge'),
chosen AS (
  SELECT now, id, max_by(card, sequence) AS card FROM (SELECT sequence, sources[1] AS now, unnest(map_keys(assignments)) AS id, unnest(map_values(assignments)) AS card FROM good WHERE action IN ('split', 'assign')) GROUP BY 1, 2),
one AS (SELECT p.id, p.card_id, CASE WHEN m.now IS NOT NULL THEN m.nxt ELSE g.card END AS now FROM printings p LEFT JOIN merges m ON m.now = p.card_id LEFT JOIN chosen g ON g.now = p.card_id AND g.id = p.id WHERE p.card_id IN (SELECT id FROM gone WHERE kind = 'card')),
two AS (SELECT o.id, o.card_id, CASE WHEN o.now IN (SELECT id FROM gone WHERE kind = 'card') THEN coalesce(m.nxt, g.card) ELSE o.now END AS now FROM one o LEFT JOIN merges m ON m.now = o.now LEFT JOIN chosen g ON g.now = o.now AND g.id = o.id),
there AS (
  SELECT 'card' AS kind, id FROM cards WHERE id NOT IN (SELECT id FROM gone WHERE kind = 'card')
  UNION ALL SELECT 'printing', id FROM printings WHERE id NOT IN (SELECT id FROM two WHERE now IS NULL) AND id NOT IN (SELECT id FROM gone WHERE kind = 'printing'))
SELECT kind, unnest(sources) AS id, 'retired' AS outcome, array_to_string(list_sort(targets), ',') AS to_id FROM good WHERE action <> 'assign'
UNION ALL SELECT 'printing', id, CASE WHEN now IS NULL THEN 'excluded' ELSE 'moved' END, now FROM two WHERE id NOT IN (SELECT id FROM gone WHERE kind = 'printing')
UNION ALL SELECT 'image', 'i' || event_id, 'dropped', NULL FROM events WHERE 'p' || event_id NOT IN (SELECT id FROM there WHERE kind = 'printing')
UNION ALL SELECT 'edge', 'e' || c_custkey, 'dropped', NULL FROM customer WHERE 'c' || c_custkey NOT IN (SELECT id FROM there WHERE kind = 'card') OR 'p' || c_custkey NOT IN (SELECT id FROM there WHERE kind = 'printing')
UNION ALL SELECT * FROM (SELECT kind, unnest(sources) AS id, 'dangling' AS outcome, unnest(targets) AS to_id FROM good WHERE action = 'merge') AS l WHERE (kind, to_id) NOT IN (SELECT kind, id FROM there) AND (kind, to_id) NOT IN (SELECT kind, id FROM gone)
UNION ALL SELECT * FROM (SELECT kind, sources[1] AS id, 'dangling' AS outcome, unnest(targets) AS to_id FROM good WHERE action = 'split') AS l WHERE (kind, to_id) NOT IN (SELECT kind, id FROM there) AND (kind, to_id) NOT IN (SELECT kind, id FROM gone)
""")
def q_correction_cascade(t: Tables) -> DataFrame:
    """Faultless corrections applied: what is retired, moved, excluded, dropped, and what dangles."""
    decisions, cards, printings = _decisions(t)
    bad = written(corrections.problems(decisions, _retained(decisions), cards, printings).select("sequence").distinct())
    images = t.events.select(F.concat(F.lit("i"), "event_id").alias("id"), F.concat(F.lit("p"), "event_id").alias("printing_id"))
    edges = t.customer.select(F.concat(F.lit("e"), "c_custkey").alias("id"), F.lit("card").alias("from_kind"), F.concat(F.lit("c"), "c_custkey").alias("from_id"), F.lit("printing").alias("to_kind"), F.concat(F.lit("p"), "c_custkey").alias("to_id"))
    return corrections.apply(written(decisions.join(bad, "sequence", "left_anti")), cards, printings, images, edges)
