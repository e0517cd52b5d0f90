"""DuckDB SQL for the opN_ queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP6 = f"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS}) AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM totals
), tried AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level,
    row_number() OVER stops AS place
  FROM weighed
  WINDOW stops AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST),
    before AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), held AS (
  SELECT arg_min(level, place) AS level FROM tried WHERE NOT weight * level > 3 * source_size
), targets AS (
  SELECT source, source_size, least(weight * coalesce(held.level, 1e300), (3 * source_size)::DOUBLE) AS target FROM tried, held
), placed AS (
  SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
    (coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS full_epochs FROM placed
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (full_epochs * size + greatest(0, least(size, budget - full_epochs * source_size - before)))::BIGINT AS taken
FROM epochs
"""

ORACLE = {"op6_mixing": OP6}

OP8 = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'
), rendered AS (
  SELECT said.conv_id, perspective, turn, speaker, text,
    CASE WHEN speaker = perspective THEN '<|im_start|>assistant' WHEN speaker = 'system' THEN '<|im_start|>system' ELSE '<|im_start|>user name=' || replace(replace(replace(speaker, '<|', '< |'), chr(10), ' '), chr(13), ' ') END || chr(10) AS head
  FROM said JOIN people ON said.conv_id IS NOT DISTINCT FROM people.conv_id
), placed AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS segment,
    coalesce(sum(length(head || text || '<|im_end|>') + 1) OVER (PARTITION BY conv_id, perspective ORDER BY turn, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM rendered
)
SELECT conv_id, perspective, turn, segment, start,
  CASE WHEN speaker = perspective THEN start + length(head) END AS mask_start,
  CASE WHEN speaker = perspective THEN start + length(segment) - 1 END AS mask_end
FROM placed
"""

OP2 = rf"""
WITH t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
word AS (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS i FROM t),
windows AS (
  SELECT id, i, count(*) OVER (PARTITION BY id, s) AS times
  FROM (SELECT id, i, list(word) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS s FROM word) WHERE len(s) = 8
), repeated AS (
  SELECT id, count(DISTINCT i + k) AS n_repeat_words FROM windows, range(8) r(k) WHERE times > 1 GROUP BY id
), lines AS (
  SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id
), f AS (
  SELECT t.id, doc_id, text, w, len(w) AS n_words, len(list_aggregate(w, 'string_agg', '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t LEFT JOIN lines USING (id) LEFT JOIN repeated USING (id)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars > 25 * n_words OR word_chars < 2 * n_words OR (n_dup_lines > 3 AND 10 * n_dup_lines > 3 * n_lines)
    OR 2 * len([x FOR x IN w IF upper(x) = x AND lower(x) <> x]) > n_words OR 2 * len([x FOR x IN w IF regexp_matches(x, '\p{{L}}')]) < n_words
    OR (n_words >= 100 AND 20 * len(list_distinct(w)) < n_words)) AS kept
FROM b
"""

ORACLE |= {"op2_quality": OP2, "op8_chat": OP8}

#: CRC-32 of the decimal doc_id: the reflected polynomial, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

OP12 = f"""
WITH read AS (SELECT row_number() OVER () AS id, doc_id, {WORDS} AS w, {_CRC} AS h FROM documents),
numbers AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM read),
made AS (
  SELECT id, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w
  FROM numbers
), word AS (SELECT id, n, unnest(w) AS word, unnest(range(n)) AS i FROM made),
equal AS (SELECT x.id, y.i - x.i AS q, x.i FROM word x JOIN word y ON x.id = y.id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT id, q, i, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS island FROM equal),
stretches AS (SELECT id, q, min(i) AS s, count(*) + q AS length FROM islands GROUP BY id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT id, s, length, min(q) AS q FROM stretches GROUP BY id, s, length),
listed AS (
  SELECT id, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS lines, first(s ORDER BY length DESC, s, q) AS s, first(length ORDER BY length DESC, s, q) AS length,
    first(q ORDER BY length DESC, s, q) AS q
  FROM run GROUP BY id
), gone AS (SELECT DISTINCT id, unnest(range(s + q, s + length)) AS i FROM run),
kept AS (SELECT id, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (id, i) GROUP BY id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, length::BIGINT AS length, q::BIGINT AS period, (1000 * length // q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM made LEFT JOIN listed USING (id) LEFT JOIN kept USING (id)
"""


def _lloyd(rounds: int) -> str:
    """The rounds one after another, each a pair of tables: the nearest centroid of each vector, and the moved centroids."""
    nearest = "SELECT id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT p.id, p.v, o.c, list_sum(list_transform(list_zip(p.v, o.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM point p, centroid{0} o) GROUP BY id"
    steps = []
    for r in range(rounds):
        steps.append(f"near{r} AS MATERIALIZED ({nearest.format(r)})")
        steps.append(f"mean{r} AS (SELECT c, k, floor(sum(x) / count(*))::BIGINT AS x FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS k FROM near{r}) GROUP BY c, k)")
        steps.append(f"centroid{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM centroid{r} o LEFT JOIN (SELECT c, list(x ORDER BY k) AS v FROM mean{r} GROUP BY c) m USING (c))")
    return ",\n".join([*steps, f"near{rounds} AS ({nearest.format(rounds)})"])


OP13 = f"""
WITH point AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), first AS (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS key, v FROM point ORDER BY key, v LIMIT 8),
centroid0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY key, v) - 1 AS c, v FROM first),
{_lloyd(10)}
SELECT p.vec_id, n.c::INT AS cluster, n.d::BIGINT AS distance, (sum(n.d) OVER (PARTITION BY n.c))::BIGINT AS cluster_inertia, (sum(n.d) OVER ())::BIGINT AS inertia,
  sha256(list_aggregate(o.v, 'string_agg', ',')) AS centroid_sha256
FROM near10 n JOIN point p USING (id) JOIN centroid10 o ON o.c = n.c
"""

ORACLE |= {"op12_periods": OP12, "op13_clusters": OP13}
