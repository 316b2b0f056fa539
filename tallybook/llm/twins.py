"""DuckDB twins of the text queries that SQL can express on whole tables."""

#: Words as the queries take them: A-Z in lower case, then runs of the given characters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


SPACED = r"[^\x20\x09-\x0D]+"
FOLDED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: One byte's step of CRC-32, for all 256 bytes, from its polynomial.
CRC_STEPS = [0] * 256
for _byte in range(256):
    _step = _byte
    for _ in range(8):
        _step = _step >> 1 ^ (0xEDB88320 if _step & 1 else 0)
    CRC_STEPS[_byte] = _step


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes."""
    data = f"list_transform(range(0, CAST(length(hex(encode({text}))) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, {CRC_STEPS}[CAST(1 + (xor(c, b) & 255) AS BIGINT)])), 4294967295)"


def field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE octet_length(encode(CAST({name} AS VARCHAR))) || ':' || {name} END"


def merkle_levels(tree: str, levels: int) -> str:
    """From ``{tree}0`` (tree, pos, node): the runs of each level, ``{tree}run<k>``, and its nodes, ``{tree}<k>``."""
    steps = []
    for k in range(levels):
        steps.append(f"""
{tree}run{k} AS (SELECT tree, pos // 8 AS pos, list(node ORDER BY pos) AS run, bool_or(many) AS many
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) > 1 AS many FROM {tree}{k}) GROUP BY 1, 2),
{tree}{k + 1} AS (SELECT tree, pos, CASE WHEN many THEN sha256(array_to_string(run, '')) ELSE run[1] END AS node FROM {tree}run{k})""")
    return ",".join(steps)


def merkle_climb(tree: str, source: str, levels: int) -> str:
    """From ``source`` (tree, pos, proof, folded), up all levels: ``{tree}up<levels>``."""
    steps = [f"{tree}up0 AS (SELECT *, pos AS own FROM {source})"]
    for k in range(levels):
        before, after = "array_to_string(run[1 : own % 8], '')", "array_to_string(run[own % 8 + 2 :], '')"
        steps.append(f"""
{tree}up{k + 1} AS (SELECT u.* REPLACE (u.own // 8 AS own, CASE WHEN many THEN proof || {before} || {after} ELSE proof END AS proof,
  CASE WHEN many THEN sha256({before} || folded || {after}) ELSE folded END AS folded) FROM {tree}up{k} u JOIN {tree}run{k} r ON u.tree = r.tree AND u.own // 8 = r.pos)""")
    return ",".join(steps)


def features(name: str) -> str:
    return f"SELECT {name}_id AS id, unnest({words(FOLDED)}) AS f FROM {dict(doc='documents', item='benchmark')[name]}"


ORACLES = {
    "op11_hash_mixing": f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '>') AS src, CAST(len({words(SPACED)}) AS BIGINT) AS size,
  CAST('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS place FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS w FROM d GROUP BY src),
r AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / CAST(w AS DOUBLE), src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remain,
  sum(w) OVER (ORDER BY 3 * source_size / CAST(w AS DOUBLE), src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares FROM s),
f AS (SELECT *, CAST(remain AS DOUBLE) * w / CAST(shares AS DOUBLE) > 3 * source_size AS full_ FROM r),
t AS (SELECT src, source_size, CASE WHEN full_ THEN CAST(3 * source_size AS DOUBLE)
  ELSE CAST(sum(source_size) OVER () - sum(CASE WHEN full_ THEN 3 * source_size ELSE 0 END) OVER () AS DOUBLE) * w / CAST(sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
c AS (SELECT d.*, source_size, target, CAST(passes AS BIGINT) AS passes, target - passes * source_size AS rest,
  sum(size) OVER (PARTITION BY src ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS below,
  row_number() OVER (PARTITION BY src ORDER BY place, doc_id, size) AS nth FROM d JOIN p USING (src)),
e AS (SELECT src, min(nth) AS edge FROM c WHERE below + size >= rest GROUP BY src)
SELECT doc_id, size, source_size, target, size * (passes + CASE WHEN nth < edge OR (nth = edge AND size > 0 AND (rest - below) / CAST(size AS DOUBLE) >= 0.5) THEN 1 ELSE 0 END) AS taken
FROM c JOIN e USING (src)""",
    "op12_merkle_manifest": f"""
WITH d AS (SELECT coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, doc_id,
  sha256({" || ".join(map(field, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
  sha256({" || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))} || coalesce(octet_length(encode(text)) || ':' || translate(text, '{UPPER}', '{LOWER}'), '-')) AS altered,
  doc_id IS NOT NULL AND {crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 3 = 0 AS tampered FROM documents),
doc0 AS (SELECT tree, pos, leaf AS node FROM d), {merkle_levels("doc", 8)},
lang0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, node, tree AS name FROM doc8), {merkle_levels("lang", 3)},
docs AS (SELECT tree, pos, doc_id, leaf, '' AS proof, CASE WHEN tampered THEN altered ELSE leaf END AS folded FROM d), {merkle_climb("doc", "docs", 8)},
langs AS (SELECT '' AS tree, l.pos, l.node AS subroot, u.doc_id, u.leaf, u.proof, u.folded FROM docup8 u JOIN lang0 l ON u.tree = l.name), {merkle_climb("lang", "langs", 3)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM langup3, (SELECT node AS root FROM lang3)""",
    "op13_importance_resampling": f"""
WITH f AS ({features("doc")}), g AS ({features("item")}),
b AS (SELECT f, {crc32("f")} % 10000 AS b FROM (SELECT f FROM f UNION SELECT f FROM g)),
s AS (SELECT b, count(*) AS n FROM f JOIN b USING (f) GROUP BY b), t AS (SELECT b, count(*) AS n FROM g JOIN b USING (f) GROUP BY b),
sums AS (SELECT (SELECT count(*) FROM f) AS s, (SELECT count(*) FROM g) AS t),
gains AS (SELECT s.b, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * (CAST(sums.s AS DOUBLE) + 10000) / ((CAST(s.n AS DOUBLE) + 1) * (CAST(sums.t AS DOUBLE) + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (b), sums),
w AS (SELECT id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN b USING (f) JOIN gains USING (b) GROUP BY id),
h AS (SELECT doc_id, CAST(CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) AS h FROM documents),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM h LEFT JOIN w ON doc_id = id),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS eligible FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * eligible // 100 THEN place END AS rank FROM scored s LEFT JOIN places p USING (doc_id)""",
    "op3_signature_tree_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {words(SPACED)} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 4) - 1), ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 2, 2))) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS together FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * together >= 85 * (x.n + y.n - together)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS start, doc_id AS node FROM documents UNION SELECT start, b FROM reach JOIN edges ON node = a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.root AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT start, min(node) AS root FROM reach GROUP BY 1) r ON d.doc_id = r.start""",
    "op5_positional_index": f"""
WITH d AS (SELECT doc_id, {words(FOLDED)} AS w FROM documents), b AS (SELECT item_id, {words(FOLDED)} AS w FROM benchmark),
asked AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 11, 2))) r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM asked),
held AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM d, sizes, unnest(range(1, len(w) - k + 2)) r(i)),
met AS (SELECT doc_id, item_id, h.k, i FROM held h JOIN asked a ON h.k = a.k AND h.s = a.s),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM met, unnest(range(0, k)) r(j) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)""",
}
