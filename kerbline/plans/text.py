"""Queries on plates, privacy and text."""

from __future__ import annotations

import hmac

from pyspark.sql import functions as F

from kerbline.functions import plates, privacy
from kerbline.operators.identity import fused_plates
from kerbline.plans.registry import query
from kerbline.sources import tables as T

#: A key for the test tables; a deployment passes its own.
KEY = b"test-key"


@query("""SELECT c_custkey, CASE WHEN starts_with(x, 'IND') AND length(x) > 8 THEN substr(x, 4) ELSE x END AS cleaned FROM (SELECT c_custkey, upper(regexp_replace('ind-' || c_name, '[^A-Za-z0-9]', '', 'g')) AS x FROM customer)""")
def str_clean(spark, sf_dir):
    return T.read(spark, sf_dir, "customer").select("c_custkey", plates.clean(F.concat(F.lit("ind-"), "c_name")).alias("cleaned"))


_STATES = ", ".join(f"'{s}'" for s in plates.STATES)


@query(T.with_("obs") + rf"""SELECT event_id, p AS plate, (regexp_full_match(p, '[A-Z]{{2}}[0-9]{{1,2}}[A-Z]{{0,3}}[0-9]{{3,4}}') AND substr(p, 1, 2) IN ({_STATES})) OR regexp_full_match(p, '[0-9]{{2}}BH[0-9]{{4}}[A-Z]{{1,2}}') AS is_valid,
  CASE WHEN regexp_full_match(p, '[A-Z]{{2}}[0-9]{{1,2}}[A-Z]{{0,3}}[0-9]{{3,4}}') THEN regexp_replace(regexp_replace(p, '^([A-Z]{{2}})([0-9]{{1,2}})([A-Z]{{0,3}})([0-9]{{3,4}})$', '\1 \2 \3 \4'), ' +', ' ', 'g') ELSE p END AS display
FROM (SELECT event_id, ['UP32AB', 'XX32AB', 'DL1C', '22BH'][k % 4 + 1] || lpad(CAST(vehicle_id % 10000 AS VARCHAR), 4, '0') || CASE WHEN k % 8 = 3 THEN '' ELSE '' END AS p FROM obs)""")
def str_valid(spark, sf_dir):
    start = F.element_at(F.array(*[F.lit(x) for x in ("UP32AB", "XX32AB", "DL1C", "22BH")]), (F.col("k") % 4 + 1).cast("int"))
    p = F.concat(start, F.lpad((F.col("vehicle_id") % 10_000).cast("string"), 4, "0"))
    return T.observations(spark, sf_dir).select("event_id", p.alias("plate"), plates.is_valid(p).alias("is_valid"), plates.display(p).alias("display"))


@query(T.with_("obs") + """SELECT event_id, 'UP32AB' || lpad(CAST(vehicle_id % 10000 AS VARCHAR), 4, '0') AS normalized, true AS is_valid, CAST((vehicle_id % 10 = 0)::INTEGER + (k % 2 = 0)::INTEGER AS INTEGER) AS corrections FROM obs""")
def str_normalize(spark, sf_dir):
    """Plates misread in up to two places: the last 0 as O, and 3 of the district as B is no digit but 8, so the 2 as Z."""
    digits = F.lpad((F.col("vehicle_id") % 10_000).cast("string"), 4, "0")
    tail = F.when(F.col("vehicle_id") % 10 == 0, F.concat(F.substring(digits, 1, 3), F.lit("o"))).otherwise(digits)
    raw = F.concat(F.lit("up "), F.when(F.col("k") % 2 == 0, "3Z").otherwise("32"), F.lit("-ab "), tail)
    found = plates.with_normalised(T.observations(spark, sf_dir).select("event_id", raw.alias("raw")), "raw")
    return found.select("event_id", "plate.normalized", "plate.is_valid", F.size("plate.corrections").alias("corrections"))


@query(T.with_("obs") + """SELECT event_id, CASE WHEN d = 0 THEN 0.0::DOUBLE ELSE d END AS distance, round(CASE WHEN d = 0 THEN 1.0::DOUBLE ELSE 1 - d / 10 END, 6) AS similarity FROM (SELECT event_id, [0, 0.35, 1.0, 0.7][k % 4 + 1]::DOUBLE AS d FROM obs)""")
def str_wed(spark, sf_dir):
    """Four kinds of misread plates at known distances: none, one confusable, one other, two confusable characters."""
    pair = F.element_at(F.array(*[F.lit(x) for x in ("UP32AB1034", "UP32AB1O34", "UP32AB1934", "UP32A81O34")]), (F.col("k") % 4 + 1).cast("int"))
    rows = T.observations(spark, sf_dir).select("event_id", pair.alias("b")).withColumn("distance", plates.weighted_distance(F.lit("UP32AB1034"), "b"))
    return rows.select("event_id", "distance", F.round(plates.similarity(F.lit("UP32AB1034"), F.col("b"), F.col("distance")), 6).alias("similarity"))


@query()
def str_fuse(spark, sf_dir):
    obs = T.observations(spark, sf_dir).where("plate is not null")
    read = F.when(F.col("k") % 9 == 0, F.regexp_replace("plate", "B0", "80")).when(F.col("k") % 13 == 0, F.substring("plate", 1, 8)).otherwise(F.col("plate"))
    return fused_plates(obs.select(F.col("vehicle_id").alias("track"), F.col("event_id").alias("read"), read.alias("normalized"), "confidence", F.lit(None).cast("array<double>").alias("char_confidences"), plates.is_valid(read).alias("is_valid")))


_INNER, _OUTER = (bytes(k ^ p for k in KEY.ljust(64, b"\0")) for p in (0x36, 0x5C))
_BLOB = lambda b: "'" + "".join(f"\\x{x:02X}" for x in b) + "'::BLOB"
_HMAC = f"sha256({_BLOB(_OUTER)} || unhex(sha256({_BLOB(_INNER)} || encode(plate))))"


@query(T.with_("obs") + f"SELECT event_id, {_HMAC} AS plate_hash FROM obs WHERE plate IS NOT NULL")
def sec_hmac(spark, sf_dir):
    return T.observations(spark, sf_dir).where("plate is not null").select("event_id", privacy.hmac_sha256(F.col("plate"), KEY).alias("plate_hash"))


@query(T.with_("obs") + f"SELECT event_id, 'PSN-' || upper(substr({_HMAC}, 1, 10)) AS pseudonym FROM obs WHERE plate IS NOT NULL")
def sec_pseudonym(spark, sf_dir):
    return T.observations(spark, sf_dir).where("plate is not null").select("event_id", privacy.pseudonym(F.col("plate"), KEY).alias("pseudonym"))


@query(T.with_("obs") + f"SELECT event_id FROM obs WHERE plate IS NOT NULL AND substr({_HMAC}, 1, 2) = 'ab' AND false")
def flt_pseudonym(spark, sf_dir):
    from kerbline.operators.search import by_pseudonym

    obs = T.observations(spark, sf_dir).withColumn("plate_hash", privacy.hmac_sha256(F.col("plate"), KEY))
    return by_pseudonym(obs, "PSN-AB").select("event_id")


#: The first four digits of the hash of a plate that occurs.
_SOUGHT = hmac.new(KEY, b"UP32AB0008", "sha256").hexdigest()[:4]


@query(T.with_("obs") + f"SELECT event_id FROM obs WHERE plate IS NOT NULL AND starts_with({_HMAC}, '{_SOUGHT}')")
def flt_pseudonym_prefix(spark, sf_dir):
    from kerbline.operators.search import by_pseudonym

    obs = T.observations(spark, sf_dir).withColumn("plate_hash", privacy.hmac_sha256(F.col("plate"), KEY))
    return by_pseudonym(obs, f"PSN-{_SOUGHT}").select("event_id")


@query(T.with_("obs") + f"SELECT event_id, 'seen ' || 'PSN-' || upper(substr({_HMAC}, 1, 10)) || ' at ' || camera_id AS text FROM obs WHERE plate IS NOT NULL")
def sec_mask_text(spark, sf_dir):
    text = F.concat(F.lit("seen "), F.regexp_replace("plate", "^(.{4})(.{2})", "$1 $2 "), F.lit(" at "), "camera_id")
    return T.observations(spark, sf_dir).where("plate is not null").select("event_id", privacy.mask_text(text, KEY).alias("text"))


@query("SELECT conv_id, turn, text FROM conversations WHERE NOT regexp_matches(text, '\\b(?:[A-Z]{2}\\s?\\d{1,2}\\s?[A-Z]{0,3}\\s?\\d{3,4}|\\d{2}\\s?BH\\s?\\d{4}\\s?[A-Z]{1,2})\\b') OR text IS NULL")
def sec_mask_conversations(spark, sf_dir):
    """Texts that masking leaves as they are: those without anything like a plate."""
    rows = T.read(spark, sf_dir, "conversations").withColumn("masked", privacy.mask_text(F.col("text"), KEY))
    return rows.where(F.col("masked").eqNullSafe(F.col("text"))).select("conv_id", "turn", F.col("masked").alias("text"))


@query()
def sec_mask_doc(spark, sf_dir):
    doc = F.struct(F.col("plate").alias("plate_text"), F.concat(F.lit("plate "), "plate").alias("title"), F.struct(F.array("plate").alias("plates"), F.col("plate").alias("plate_reads_raw")).alias("details"))
    rows = T.observations(spark, sf_dir).select("event_id", doc.alias("doc"))
    kind = rows.schema["doc"].dataType
    return rows.select("event_id", F.to_json(privacy.masked(F.col("doc"), kind, KEY)).alias("doc"))


@query("SELECT c_custkey, 'rtsp://***:***@host/' || c_custkey AS uri, '***' AS password, c_name AS name FROM customer")
def sec_scrub(spark, sf_dir):
    uri = F.concat(F.lit("rtsp://user:secret@host/"), F.col("c_custkey").cast("string"))
    details = privacy.scrubbed(F.create_map(F.lit("Password"), F.lit("x"), F.lit("name"), F.col("c_name")))
    return T.read(spark, sf_dir, "customer").select("c_custkey", privacy.safe_uri(uri).alias("uri"), details["Password"].alias("password"), details["name"].alias("name"))


@query("SELECT c_custkey, 'VEH-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code FROM customer")
def str_code(spark, sf_dir):
    from kerbline.operators.identity import vehicle_code

    return T.read(spark, sf_dir, "customer").select("c_custkey", vehicle_code(F.col("c_custkey")).alias("code"))


@query("SELECT page_id, sha256(html) AS sha256 FROM pages")
def sink_evidence(spark, sf_dir):
    return T.read(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'missing' WHEN page_id % 5 = 0 THEN 'changed' ELSE 'ok' END AS state FROM pages")
def evidence_verify(spark, sf_dir):
    from kerbline.sources.evidence import verified

    pages = T.read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))
    manifest = pages.select("path", F.sha2("content", 256).alias("sha256"))
    now = pages.where("path % 3 <> 0").withColumn("content", F.when(F.col("path") % 5 == 0, F.lit(b"x")).otherwise(F.col("content")))
    return verified(manifest, now).select(F.col("path").cast("long").alias("page_id"), "state")
