"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import centroids, chat_format, importance, lang_id, license_scan, lm_score, minhash, mixing, neighbours, packing, secret_scan, token_counts, vector_dedup
from kerbline.llm.shared import columns, table


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document by a model learnt from those outside the fold that is held out."""
    docs = table(spark, sf_dir, "documents")
    found = lm_score.score(docs, _fold(5) != 1)
    return found.select("doc_id", (_fold(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those outside the fold that is held out."""
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs.where(_fold(4) != 2))
    return lang_id.predict(docs, model).select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document."""
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from all formatted conversations and one whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = columns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.digests(chat_format.format_conversations(turns))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings."""
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all embeddings for each whose id is divisible by 50."""
    return neighbours.search(neighbours.index(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, 5)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in full sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix_documents(table(spark, sf_dir, "documents")).drop("sources", "source")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on shingles of two words."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files written for all documents."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and a digest of the base kinds, and the spans of all kinds."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE]
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda kinds: F.filter("spans", lambda x: x["kind"].isin(kinds))
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(told(of(base)), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a draw of a quarter towards the benchmark."""
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every embedding of 64 components, after five rounds with 40 centroids."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (op1_lm_score, op2_language_id, op3_license_scan, op4_chat_format, op5_vector_dedup, op6_neighbours, op7_packing, op8_mixing, op9_minhash, op10_token_counts, op11_secret_scan, op12_importance, op13_centroids)
    }


def _controls(x: str) -> str:
    """SQL for the code points that escaping adds to ``x``."""
    counted = [f"(length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}" for c in chat_format.CONTROL]
    return f"length({x}) - length(replace({x}, '\\', '')) + " + " + ".join(counted)


_MARKS = sum(map(len, chat_format.CONTROL[:3]))

OP4_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  CAST(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN r = 'assistant' THEN t ELSE '' END, '' ORDER BY turn NULLS FIRST, r, t)) AS loss_sha256,
  CAST(sum({_MARKS} + length(r) + length(t) + {_controls("r")} + {_controls("t")}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def mixing_sql(docs: str) -> str:
    """CTEs over ``docs`` (doc_id, text, source) that end in mixed(doc_id, source, size, source_size, target, taken)."""
    return f"""
sizes AS (
  SELECT *, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size FROM {docs}),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT source, source_size, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS w,
    1.5::DOUBLE * sum(source_size) OVER () AS total FROM per_source),
ranked AS (
  SELECT *, 2.0::DOUBLE * source_size / w AS full_at, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source) AS k FROM weighed),
levels AS (
  SELECT k, full_at, (total - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM ranked),
level AS (SELECT arg_min(unit, k) AS unit FROM levels WHERE unit < full_at),
targets AS (
  SELECT source, source_size, CASE WHEN unit IS NULL OR unit * w >= 2.0::DOUBLE * source_size THEN 2.0::DOUBLE * source_size ELSE unit * w END AS target
  FROM weighed, level),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size + 1e-9)) ELSE 0 END AS whole FROM targets),
mixed AS (
  SELECT doc_id, s.source, text, lang, n_chars, size, source_size, target, CAST(size * (whole + CASE WHEN target - whole * source_size > 0.5
    AND sum(size) OVER (PARTITION BY s.source ORDER BY md5('mix-1:' || doc_id), doc_id) - size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
  FROM sizes s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source)"""


OP8_SQL = f"WITH {mixing_sql('documents').strip()} SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, taken FROM mixed"


def _sequential_sum(x: str) -> str:
    return f"list_reduce({x}, lambda a, b: a + b)"


_VECTORS = f"""
usable AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
normed AS (SELECT vec_id, x, sqrt({_sequential_sum("list_transform(x, lambda c: c * c)")}) AS n FROM usable)"""


def _cosine(p: str, q: str) -> str:
    return f"{_sequential_sum(f'list_transform(list_zip({p}.x, {q}.x), lambda c: c[1] * c[2])')} / ({p}.n * {q}.n)"


OP5_SQL = f"""
WITH RECURSIVE {_VECTORS.strip()},
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM normed p JOIN normed q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE {_cosine("p", "q")} >= 0.95),
reached AS (SELECT a, b FROM links UNION SELECT r.a, s.b FROM reached r JOIN links s ON r.b = s.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, least(e.vec_id, coalesce(m.low, e.vec_id)) AS component_id, e.vec_id <= coalesce(m.low, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT a, min(b) AS low FROM reached GROUP BY a) m ON m.a = e.vec_id
"""

OP6_SQL = f"""
WITH {_VECTORS.strip()},
scored AS (
  SELECT p.vec_id AS query_id, q.vec_id, {_cosine("p", "q")} AS score
  FROM normed p JOIN normed q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE p.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def near_duplicate_sql(docs: str, k: int) -> str:
    """CTEs over ``docs`` (doc_id, text) that end in components(doc_id, n_shingles, component_id, kept)."""
    grams = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""
split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM {docs}),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, CASE WHEN len(w) < {k} THEN array_to_string(w, ' ') ELSE {grams} END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {k} + 2))) AS i FROM split WHERE len(w) > 0))),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT a, b FROM sides UNION SELECT r.a, s.b FROM reached r JOIN sides s ON r.b = s.a),
components AS (
  SELECT d.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id, d.doc_id <= coalesce(min(r.b), d.doc_id) AS kept
  FROM {docs} d LEFT JOIN sizes z USING (doc_id) LEFT JOIN reached r ON r.a = d.doc_id GROUP BY d.doc_id)"""


OP9_SQL = f"WITH RECURSIVE {near_duplicate_sql('documents', 2).strip()} SELECT * FROM components"


def _either_case(pattern: str) -> str:
    """``pattern`` with its letters A-Z in either case, outside of classes and escapes."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            n = 4 if pattern[i + 1] == "x" else 2
            out.append(pattern[i : i + n])
            i += n
            continue
        inside = (inside or c == "[") and c != "]"
        out.append(f"[{c.upper()}{c.lower()}]" if c.isascii() and c.isalpha() and not inside else c)
        i += 1
    return "".join(out)


def _spans_sql(order: int, rule: secret_scan.Rule) -> str:
    """Spans of one kind: where the pieces between matches and the matches before it end."""
    regex = (_either_case(rule.pattern) if rule.either_case else rule.pattern).replace("'", "''")
    return f"""SELECT r, {order} AS k, '{rule.kind}' AS kind, CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS first, length(found[i]) AS n
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
    SELECT r, string_split_regex(t, '{regex}') AS pieces, regexp_extract_all(t, '{regex}') AS found, regexp_extract_all(t, '{regex}', {rule.group}) AS told FROM texts)) WHERE length(told[i]) >= {rule.least}"""


OP11_SQL = f"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_spans_sql(i, r) for i, r in enumerate(secret_scan.RULES))}),
told AS (
  SELECT r, {", ".join(f"count(*) FILTER (WHERE k = {i}) AS n_{x.kind}" for i, x in enumerate(secret_scan.BASE))},
    string_agg(kind || ':' || first || ':' || (first + n), ',' ORDER BY first, k) FILTER (WHERE k < {len(secret_scan.BASE)}) AS base, string_agg(kind || ':' || first || ':' || (first + n), ',' ORDER BY first, k) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{x.kind}, 0) AS n_{x.kind}" for x in secret_scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN told USING (r)
"""

_CRC_STEP = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
OP12_SQL = f"""
WITH crcs AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, step: {_CRC_STEP}) ORDER BY i) AS crc FROM range(256) u(i)),
words AS (
  SELECT which, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 0 AS which, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark)),
features AS MATERIALIZED (SELECT which, r, unnest(list_concat(w, list_transform(range(1, greatest(1, len(w))), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
counted AS MATERIALIZED (SELECT which, r, f, count(*) AS n FROM features GROUP BY ALL),
bytes AS (SELECT f, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)) AS b FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted))),
buckets AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295, b), lambda s, c: xor(crc[(xor(s, c) & 255) + 1], s >> 8)), 4294967295) % {importance.BUCKETS} AS bucket FROM bytes, crcs),
sums AS (SELECT bucket, sum(CASE WHEN which = 0 THEN n ELSE 0 END) AS s, sum(CASE WHEN which = 1 THEN n ELSE 0 END) AS t FROM counted JOIN buckets USING (f) GROUP BY bucket),
totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM sums),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (all_s + {importance.BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (all_t + {importance.BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM sums, totals),
weights AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE) AS BIGINT) AS weight FROM counted JOIN buckets USING (f) JOIN gains USING (bucket) WHERE which = 0 GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (r) WHERE which = 0),
ranks AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank, count(*) OVER () AS able FROM scored WHERE n_words >= {importance.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {importance.DRAWN_PERCENT} * able // 100 THEN rank END AS rank FROM scored LEFT JOIN ranks USING (r)
"""


def _lloyd_sql() -> str:
    """Rounds written out: assigned0, centroids1, assigned1 and so on."""
    steps = []
    for i in range(centroids.ROUNDS + 1):
        steps.append(f"""assigned{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, CAST(min(d * 64 + c) % 64 AS INTEGER) AS c, CAST(min(d * 64 + c) // 64 AS BIGINT) AS d
  FROM (SELECT r, vec_id, k.x, c, list_sum(list_transform(list_zip(k.x, m.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept k, centroids{i} m) GROUP BY r)""")
        if i < centroids.ROUNDS:
            steps.append(f"""means{i} AS (SELECT c, list(m ORDER BY j) AS x FROM (SELECT c, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
    SELECT c, j, sum(v) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS v, unnest(range({centroids.DIMENSIONS})) AS j FROM assigned{i}) GROUP BY c, j)) GROUP BY c),
centroids{i + 1} AS MATERIALIZED (SELECT p.c, coalesce(q.x, p.x) AS x FROM centroids{i} p LEFT JOIN means{i} q USING (c))""")
    return ",\n".join(steps)


OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(c::DOUBLE * {centroids.SCALE}) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {centroids.DIMENSIONS} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
centroids0 AS MATERIALIZED (SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id), x) - 1 AS c, x FROM kept) WHERE c < {centroids.CLUSTERS}),
{_lloyd_sql()}
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM assigned{centroids.ROUNDS} JOIN centroids{centroids.ROUNDS} m USING (c)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat_format": OP4_SQL, "op5_vector_dedup": OP5_SQL, "op6_neighbours": OP6_SQL, "op8_mixing": OP8_SQL, "op9_minhash": OP9_SQL, "op11_secret_scan": OP11_SQL, "op12_importance": OP12_SQL, "op13_centroids": OP13_SQL,
    }
