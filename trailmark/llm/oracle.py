"""What the queries of this folder return, in DuckDB SQL, where SQL can say it over whole tables.

The others train a model, draw at random or learn weights; tests hold them against plain versions of themselves.
"""

from __future__ import annotations

#: CRC-32 (polynomial 0xEDB88320) of a list of bytes, by a table that is made from its rule.
CRC = """
bits AS (SELECT i, 0 AS step, i::BIGINT AS c FROM range(256) r(i)
  UNION ALL SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8)"""
BYTES_OF = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)"

SHARDS = f"""
WITH RECURSIVE {CRC},
sized AS (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, coalesce(left(md5(text), 15), repeat('0', 15)) AS h,
    xor(4294967295, list_reduce({BYTES_OF}, lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1]), 4294967295::BIGINT)) AS crc32
  FROM documents, crc),
placed AS (SELECT *, (sum(size) OVER (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM sized),
goals AS (SELECT i, sum(size)::DOUBLE * i / 16 AS goal, 0.005::DOUBLE * sum(size) / 16 AS slack FROM sized, range(1, 16) r(i) GROUP BY i),
edges AS (SELECT 'group' AS kind, max(upto) AS spot FROM placed GROUP BY h UNION ALL SELECT 'row', upto FROM placed
  UNION ALL VALUES ('group', 0), ('row', 0)),
near AS (SELECT i, kind, goal, slack, max(spot) FILTER (WHERE spot <= goal) AS lo, min(spot) FILTER (WHERE spot > goal) AS hi FROM goals, edges GROUP BY ALL),
best AS (SELECT i, kind, goal, slack, CASE WHEN hi - goal < goal - lo THEN hi ELSE lo END AS spot FROM near),
chosen AS (SELECT i, CASE WHEN abs(max(spot) FILTER (WHERE kind = 'group') - any_value(goal)) <= any_value(slack) THEN max(spot) FILTER (WHERE kind = 'group')
    ELSE max(spot) FILTER (WHERE kind = 'row') END AS spot FROM best GROUP BY i),
dealt AS (SELECT p.*, (SELECT count(*) FROM chosen c WHERE c.spot <= p.upto - p.size)::INTEGER AS shard FROM placed p)
SELECT doc_id, size::BIGINT AS size, crc32 AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY upto) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM dealt"""

#: Windows of 50 bytes, as 100 hex digits; those that a smaller id has too; their runs; what is between the runs.
REMOVED = """
WITH hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS w FROM (SELECT doc_id, x, unnest(range(strlen(x) // 2 - 49)) AS i FROM hexed)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS least FROM windows) WHERE least < doc_id),
numbered AS (SELECT doc_id, i, count(*) FILTER (WHERE far) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS far FROM hits)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, run),
pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
    string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
  FROM pieces JOIN hexed USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (strlen(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM hexed LEFT JOIN cut USING (doc_id)"""

UPPER_, LOWER_ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The five primes of XXH64.
P1, P2, P3, P4, P5 = (f"{p}::UHUGEINT" for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _mod(x: str) -> str:
    return f"(({x}) & 18446744073709551615::UHUGEINT)"


def _turn(x: str, r: int) -> str:
    """x turned left by r bits: what leaves above comes in below."""
    return f"(({_mod(f'({x}) << {r}')}) | (({x}) >> {64 - r}))"


def _lane(acc: str, lane: str) -> str:
    return _mod(f"{_turn(_mod(f'{acc} + {_mod(f"{lane} * {P2}")}'), 31)} * {P1}")


def _number(at: str, n: int) -> str:
    """n bytes of hex digits x from place `at`, the last counting most."""
    return "('0x' || " + " || ".join(f"substr(x, 2 * ({at} + {i}) + 1, 2)" for i in reversed(range(n))) + ")::UBIGINT::UHUGEINT"


def _xxh64(source: str) -> str:
    """CTEs that end in hashed(x, h): the XXH64 with seed 42 of each x (hex digits) of `source`."""
    start = [f"{(42 + 0x9E3779B185EBCA87 + 0xC2B2AE3D27D4EB4F) % (1 << 64)}", f"{42 + 0xC2B2AE3D27D4EB4F}", "42", f"{(42 - 0x9E3779B185EBCA87) % (1 << 64)}"]
    lanes = [f"list_reduce(list_transform(range(n // 32), lambda j: {_number(f'32 * j + {8 * k}', 8)}), lambda s, y: {_lane('s', 'y')}, {start[k]}::UHUGEINT) AS v{k}" for k in range(4)]
    joined = " + ".join(_turn(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18)))
    met = [f"{_mod(f'{_mod(f"xor(h, {_lane('0::UHUGEINT', f'v{k}')}) * {P1}")} + {P4}')} AS h" for k in range(4)]
    steps = [f"SELECT x, n, v0, v1, v2, v3, {_mod(joined)} AS h FROM striped WHERE n >= 32"]
    for m in met:
        steps.append(f"SELECT x, n, v0, v1, v2, v3, {m} FROM ({steps[-1]})")
    eights = f"list_transform(range(n % 32 // 8), lambda j: {_number('n // 32 * 32 + 8 * j', 8)})"
    four = f"CASE WHEN n % 8 >= 4 THEN [{_number('n // 8 * 8', 4)}] ELSE [] END"
    ones = f"list_transform(range(n % 4), lambda j: {_number('n // 4 * 4 + j', 1)})"
    by_eight = _mod(f"{_mod(f'{_turn(f"xor(s, {_lane('0::UHUGEINT', 'y')})", 27)} * {P1}')} + {P4}")
    by_four = _mod(f"{_mod(f'{_turn(f"xor(s, {_mod(f'y * {P1}')})", 23)} * {P2}')} + {P3}")
    by_one = _mod(f"{_turn(f'xor(s, {_mod(f"y * {P5}")})', 11)} * {P1}")
    return f"""
sized AS (SELECT DISTINCT x, strlen(x) // 2 AS n FROM {source}),
striped AS (SELECT x, n, {", ".join(lanes)} FROM sized),
begun AS (SELECT x, n, h FROM ({steps[-1]}) UNION ALL SELECT x, n, {42 + 0x27D4EB2F165667C5}::UHUGEINT FROM sized WHERE n < 32),
eighth AS (SELECT x, n, list_reduce({eights}, lambda s, y: {by_eight}, {_mod("h + n::UHUGEINT")}) AS h FROM begun),
fourth AS (SELECT x, n, list_reduce({four}, lambda s, y: {by_four}, h) AS h FROM eighth),
ended AS (SELECT x, list_reduce({ones}, lambda s, y: {by_one}, h) AS h FROM fourth),
once AS (SELECT x, {_mod(f"xor(h, h >> 33) * {P2}")} AS h FROM ended),
twice AS (SELECT x, {_mod(f"xor(h, h >> 29) * {P3}")} AS h FROM once),
hashed AS (SELECT x, xor(h, h >> 32)::UBIGINT AS h FROM twice)"""


NEAR = f"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER_}', '{LOWER_}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingled AS (SELECT doc_id, hex(encode(unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1 : i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END))) AS x FROM worded),
{_xxh64("shingled")},
printed AS (SELECT doc_id, ({" || ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN '1' ELSE '0' END" for b in reversed(range(64)))}) AS bits
  FROM shingled JOIN hashed USING (x) GROUP BY doc_id),
prints AS (SELECT doc_id, coalesce(list_reduce(list_transform(string_split(bits, ''), lambda b: b::UBIGINT), lambda s, b: 2 * s + b), 0)::UBIGINT AS fp
  FROM documents LEFT JOIN printed USING (doc_id)),
nodes AS (SELECT fp, min(doc_id) AS id FROM prints GROUP BY fp),
edges AS (SELECT a.fp AS a, b.fp AS b FROM nodes a, nodes b WHERE bit_count(xor(a.fp, b.fp)) <= 4),
reached AS (SELECT fp AS a, fp AS b FROM nodes UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a),
named AS (SELECT r.a AS fp, min(n.id) AS component_id FROM reached r JOIN nodes n ON r.b = n.fp GROUP BY r.a)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM prints JOIN named USING (fp)"""

SQL = {"op1_histogram_shards": SHARDS, "op5_suffix_dedup": REMOVED, "op9_simhash_gray": NEAR}
