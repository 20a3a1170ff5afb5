"""SQL (DuckDB) with the same rows as some queries, by the plainest way: every pair, every window, every quotient."""

from .jaccard import N, PERCENT
from .mixing import BLOCK, MOST_REPEATS, SEED, SHARD, WEIGHTS
from .substrings import WINDOW

WORDS = r"'[^\x20\x09-\x0D]+'"
A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _reach(edges: str, node: str) -> str:
    """CTEs that end in least(node, root): the smallest node reachable in the CTE `edges` (a, b), both directions."""
    return f"""reach(node, root) AS (SELECT {node}, {node} FROM nodes UNION SELECT e.b, r.root FROM reach r JOIN {edges} e ON e.a = r.node WHERE e.a <> e.b),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"""


JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{A_Z}', '{A_Z.lower()}'), {WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {N} THEN [md5(array_to_string(w[k:k + {N - 1}], ' ')) for k in generate_series(1, len(w) - {N - 1})] WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END) AS t FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), nodes AS (SELECT DISTINCT doc_id FROM documents),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2),
edges AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
{_reach("edges", "doc_id")}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least.root AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN least ON least.node = d.doc_id"""

VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), good AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len([e for e in x if e IS NULL OR NOT isfinite(e)]) = 0 AND len([e for e in x if e <> 0]) > 0),
nodes AS (SELECT DISTINCT vec_id FROM embeddings), edges AS (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
{_reach("edges", "vec_id")}, n AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least.root AS component_id, e.vec_id = least.root AS kept FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN least ON least.node = e.vec_id"""

SUBSTRINGS = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
p AS (SELECT doc_id, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS k, w FROM w WHERE len(w) >= {WINDOW}), h AS (SELECT doc_id, k, md5(array_to_string(w[k:k + {WINDOW - 1}], ' ')) AS h FROM p),
again AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1), hit AS (SELECT doc_id, k FROM h SEMI JOIN again USING (h)), gone AS (SELECT DISTINCT doc_id, k + j AS k FROM hit CROSS JOIN (SELECT unnest(generate_series(0, {WINDOW - 1})) AS j)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS k FROM w), stay AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS kept FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(stay.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(stay.kept, '')) AS kept_sha256 FROM w LEFT JOIN stay USING (doc_id)"""


def _seeded(*cols: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{SEED}', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)})), 1, 15) AS BIGINT)"


_weights = f"[{', '.join(map(str, WEIGHTS))}][1 + (rank - 1) % {len(WEIGHTS)}]"
MIXING = f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORDS})) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source), s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0), s2 AS (SELECT *, {_weights} AS weight, source_size * {MOST_REPEATS} AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM s2 WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, (cap / weight, rank)) AS water FROM s3 WHERE level * weight <= cap), src AS (SELECT source, rank, source_size, least(CAST(cap AS DOUBLE), weight * water) AS target, greatest(CAST(sum(source_size) OVER () AS BIGINT) // {BLOCK}, 1) AS blocks FROM s3, water),
q AS (SELECT rank, blocks, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank, k) AS place FROM (SELECT rank, target, blocks, unnest(generate_series(0, blocks)) AS k FROM src WHERE target > 0)), quota AS (SELECT rank, count(*) AS seats FROM q WHERE place <= blocks GROUP BY rank),
e AS (SELECT d.*, rank, source_size, target, {_seeded("doc_id")} AS hash FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source), f AS (SELECT *, hash % greatest(CAST(ceil(source_size / {SHARD}) AS BIGINT), 1) AS shard FROM e),
sh AS (SELECT rank, shard, CAST(sum(size) AS BIGINT) AS shard_size, coalesce(any_value(seats), 0) AS seats FROM f LEFT JOIN quota USING (rank) GROUP BY rank, shard),
qs AS (SELECT rank, shard, seats, row_number() OVER (PARTITION BY rank ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS place FROM (SELECT *, unnest(generate_series(0, seats)) AS k FROM sh WHERE shard_size > 0)), qq AS (SELECT rank, shard, count(*) AS quota FROM qs WHERE place <= seats GROUP BY rank, shard),
want AS (SELECT rank, shard, shard_size, greatest(shard_size, 1) AS z, least(coalesce(quota, 0) * {BLOCK}, shard_size * {MOST_REPEATS}) AS wanted FROM sh LEFT JOIN qq USING (rank, shard)),
run AS (SELECT *, wanted // z AS passes, wanted % z AS words, {_seeded("rank", "shard")} % CAST(ceil(z / {BLOCK}) AS BIGINT) * {BLOCK} AS begin_ FROM want),
g AS (SELECT f.*, shard_size, passes, words, begin_, sum(size) OVER (PARTITION BY rank, shard ORDER BY hash, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS first_ FROM f JOIN run USING (rank, shard))
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(least(first_ + size, begin_ + words) - greatest(first_, begin_), 0) + greatest(least(first_ + size, begin_ - shard_size + words) - greatest(first_, begin_ - shard_size), 0) AS BIGINT) AS taken FROM g"""

ORACLES = {"op2_jaccard": JACCARD, "op4_caps": VECTORS, "op7_mixing": MIXING, "op10_substrings": SUBSTRINGS}
