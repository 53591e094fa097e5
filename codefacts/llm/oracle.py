"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from codefacts.llm import mixing, orchard

EMBEDDING_DEDUP = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
), unit AS (
  SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM good
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.u) = len(b.u)
  WHERE list_dot_product(a.u, b.u) >= 0.93
), reached AS (
  SELECT a AS vec_id, b AS other FROM links UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other
), smallest AS (
  SELECT vec_id, least(vec_id, min(other)) AS component_id FROM reached GROUP BY vec_id
), counted AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(s.component_id, v.vec_id) AS component_id,
       coalesce(s.component_id, v.vec_id) = v.vec_id AS kept
FROM embeddings v LEFT JOIN counted n USING (vec_id) LEFT JOIN smallest s USING (vec_id)
"""

JACCARD_JOIN = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM worded
), tokens AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common WHERE 100 * c >= 75 * (na + nb - c)
), reached AS (
  SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
), smallest AS (
  SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.other, s.doc_id)) AS component_id
FROM sets s LEFT JOIN smallest m USING (doc_id)
"""


def source_mixing() -> str:
    """The raking of ``mixing.mix`` with its default parameters, its rounds written out one after the other."""
    names = ("source", "lang", "topic")
    steps = [
        f"""
worded AS (
  SELECT doc_id, source, lang, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda w: w <> '') AS w FROM documents
), placed AS (
  SELECT doc_id, source, lang, len(w)::BIGINT AS n_tokens, list_min(list_filter(w, lambda x: length(x) >= {mixing.KEY_LENGTH})) AS k FROM worded
), docs AS (
  SELECT doc_id, source, lang, n_tokens,
    CASE WHEN k IS NULL THEN 0 ELSE ('0x' || substr(md5(k), 1, 8))::BIGINT % {mixing.TOPICS} END AS topic FROM placed
), cells AS (
  SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL
), m0 AS (
  SELECT *, tokens AS mass FROM cells
)"""
    ]
    for name in names:
        steps.append(
            f"""t_{name} AS (
  SELECT {name} AS v, pow(sum(tokens), {mixing.FLATTEN}) AS pull FROM cells GROUP BY {name}
), g_{name} AS (
  SELECT v, pull * (SELECT sum(tokens) FROM cells) / (SELECT sum(pull) FROM t_{name}) AS target FROM t_{name}
)"""
        )
    at = 0
    for _ in range(mixing.ROUNDS):
        for name in names:
            steps.append(
                f"""m{at + 1} AS MATERIALIZED (
  SELECT m.source, m.lang, m.topic, m.tokens, CASE WHEN s.now > 0 THEN m.mass * g.target / s.now ELSE 0 END AS mass
  FROM m{at} m JOIN (SELECT {name} AS v, sum(mass) AS now FROM m{at} GROUP BY {name}) s ON m.{name} IS NOT DISTINCT FROM s.v
  JOIN g_{name} g ON m.{name} IS NOT DISTINCT FROM g.v
)"""
            )
            at += 1
    grid, share = mixing.GRID, mixing.KEEP_SHARE
    steps.append(
        f"""grow AS (
  SELECT *, mass / tokens AS g FROM m{at} WHERE tokens > 0
), edge AS (
  SELECT 1 / min(g) AS high, {share} * sum(tokens) * (1 + 1e-9) AS budget FROM grow WHERE g > 0
), coarse AS (
  SELECT high * pow(2.0, -i / 2.0) AS s FROM edge, range({grid}) r(i)
), low AS (
  SELECT coalesce(max(s), 0) AS low FROM (SELECT s, sum(tokens * least(1.0, g * s)) AS held FROM coarse, grow GROUP BY s), edge WHERE held <= budget
), above AS (
  SELECT low, coalesce((SELECT min(s) FROM coarse WHERE s > low), low) AS up FROM low
), fine AS (
  SELECT low + (up - low) * i / {grid} AS s FROM above, range({grid} + 1) r(i)
), rate AS (
  SELECT coalesce(max(s), 0) AS rate FROM (SELECT s, sum(tokens * least(1.0, g * s)) AS held FROM fine, grow GROUP BY s), edge WHERE held <= budget
), final AS (
  SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1.0, mass / tokens * (SELECT rate FROM rate)) ELSE 1.0 END AS p FROM m{at}
)"""
    )
    return (
        "WITH "
        + ", ".join(steps)
        + """
SELECT d.doc_id, d.topic, d.n_tokens, round(f.p, 6) AS keep_probability,
  (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':mix'), 1, 8))::BIGINT / pow(16.0, 8) < f.p)::INTEGER AS kept
FROM docs d JOIN final f ON d.source IS NOT DISTINCT FROM f.source AND d.lang IS NOT DISTINCT FROM f.lang AND d.topic = f.topic
"""
    )


CONVERSATION_TRIE = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'r': r, 't': t} ORDER BY turn NULLS FIRST, r, t) AS s FROM turns GROUP BY conv_id
), hashed AS (
  SELECT conv_id, s, xor(list_reduce(
      flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
      lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295::BIGINT), 4294967295::BIGINT) % 9 AS h
  FROM own
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.s[1:o.h], []), o.s[o.h + 1:]) AS s FROM hashed o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
), prefixes AS (
  SELECT conv_id, d, s[1:d] AS p, len(s) = d AS ends FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE strlen(p[d].t) END AS size,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends
  FROM prefixes GROUP BY d, p
), below AS (
  SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), counted AS (
  SELECT n.*, coalesce(b.n_children, 0) AS n_children FROM nodes n LEFT JOIN below b ON n.p = b.p
), sums AS (
  SELECT p[1:k] AS p, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM counted) GROUP BY ALL
)
SELECT c.conv_id, c.d AS depth, up.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted c JOIN sums s ON s.p = c.p LEFT JOIN nodes up ON c.d > 0 AND up.p = c.p[1:c.d - 1]
"""


def orchard_clusters() -> str:
    """The rounds of ``orchard.cluster`` with its default parameters, every centroid measured, written out one after the other."""
    size, k = orchard.SIZE, orchard.CENTROIDS
    steps = [
        f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({orchard.SCALE} * x)::BIGINT) AS u FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, u) - 1 AS c, u AS m
  FROM (SELECT sha256('{orchard.SALT}:' || vec_id) AS h, u FROM kept ORDER BY h NULLS LAST, u LIMIT {k})
)"""
    ]
    for i in range(orchard.ROUNDS + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
  SELECT r, min(d) AS d, arg_min(c, (d, c)) AS c
  FROM (SELECT r, c, list_sum(list_transform(list_zip(u, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{i}) GROUP BY r
)"""
        )
        if i < orchard.ROUNDS:
            steps.append(
                f"""p{i} AS (
  SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS m
  FROM (SELECT a.c, g.i, sum(k.u[g.i]) AS s, count(*)::HUGEINT AS n FROM a{i} a JOIN kept k USING (r), range(1, {size + 1}) g(i) GROUP BY a.c, g.i)
), c{i + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN (SELECT c, list(m ORDER BY i) AS m FROM p{i} GROUP BY c) n USING (c)
)"""
            )
    last = orchard.ROUNDS
    return (
        "WITH "
        + ", ".join(steps)
        + f"""
SELECT k.vec_id, a.c::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
  sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m.m, ',')) AS centroid_sha256
FROM a{last} a JOIN kept k USING (r) JOIN c{last} m ON m.c = a.c
"""
    )


ORACLES: dict[str, str] = {
    "op3_source_mixing": source_mixing(),
    "op6_embedding_dedup": EMBEDDING_DEDUP,
    "op10_jaccard_join": JACCARD_JOIN,
    "op11_conversation_trie": CONVERSATION_TRIE,
    "op12_orchard_clusters": orchard_clusters(),
}
