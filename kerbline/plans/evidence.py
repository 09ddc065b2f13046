"""Queries on evidence by cases: pages as a case's files, five a case, one for each role."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.plans.registry import query
from kerbline.sources import cases
from kerbline.sources import tables as T
from kerbline.sources.lineage import shared_path

#: Of pages with one case and role the one with the least path counts, as for the operator.
_FILES = """files AS (
  SELECT page_id, page_id // 5 AS case_id, page_id % 5 + 1 AS o, ['vehicle', 'plate', 'detection', 'before', 'after'][page_id % 5 + 1] AS role, 'case-' || (page_id // 5) || '/' || page_id || '.html' AS path, sha256(html) AS sha256, octet_length(encode(html)) AS bytes
  FROM pages WHERE html IS NOT NULL),
manifests AS (
  SELECT *, sha256(manifest) AS manifest_sha256 FROM (SELECT case_id, '{"case_id":' || case_id || ',"files":[' || string_agg('{"role":"' || role || '","path":"' || path || '","sha256":"' || sha256 || '","bytes":' || bytes || '}', ',' ORDER BY o) || ']}' AS manifest
  FROM files GROUP BY case_id))"""


def _files(spark, sf_dir):
    role = F.element_at(F.array(*[F.lit(r) for r in cases.ROLES]), (F.col("page_id") % 5 + 1).cast("int"))
    case = F.floor(F.col("page_id") / 5)
    return T.read(spark, sf_dir, "pages").select(case.alias("case_id"), case.cast("double").alias("t"), role.alias("role"), F.concat(F.lit("case-"), case, F.lit("/"), "page_id", F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"), "page_id")


@query("WITH " + _FILES + " SELECT case_id, manifest, manifest_sha256 FROM manifests")
def sink_evidence_cases(spark, sf_dir):
    """Files and manifests written to the shared folder, and the manifests as they are there."""
    path = shared_path(spark, "evidence")
    cases.written(_files(spark, sf_dir), path)
    return cases.read(spark, path)[1]


@query("WITH " + _FILES + """, n4 AS (SELECT left(sha256(case_id::VARCHAR), 4) AS prefix, sha256(string_agg(case_id || ' ' || manifest_sha256, chr(10) ORDER BY case_id::VARCHAR)) AS sha256, count(*)::BIGINT AS cases FROM manifests GROUP BY 1),
""" + ",\n".join(f"n{i} AS (SELECT left(prefix, {i}) AS prefix, sha256(string_agg(prefix || ' ' || sha256, chr(10) ORDER BY prefix)) AS sha256, sum(cases)::BIGINT AS cases FROM n{i + 1} GROUP BY 1)" for i in (3, 2, 1, 0))
+ " SELECT * FROM n4 UNION ALL SELECT * FROM n3 UNION ALL SELECT * FROM n2 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n0")
def sink_evidence_tree(spark, sf_dir):
    """Every node of the tree of hashes over the manifests; the root has no prefix."""
    return cases.tree(cases.manifests(_files(spark, sf_dir)))


@query("WITH " + _FILES + """, states AS (
  SELECT case_id, CASE WHEN page_id % 11 = 0 THEN 'missing' WHEN page_id % 7 = 0 THEN 'changed' ELSE 'ok' END AS state, CASE WHEN case_id % 13 = 0 THEN 'missing' WHEN case_id % 6 = 0 THEN 'changed' ELSE 'ok' END AS manifest_state FROM files)
SELECT case_id, bool_and(state = 'ok' AND manifest_state = 'ok') AS valid, max(manifest_state) AS manifest_state, count_if(state = 'ok')::BIGINT AS ok, count_if(state = 'changed')::BIGINT AS changed, count_if(state = 'missing')::BIGINT AS missing, 0::BIGINT AS unlisted
FROM states GROUP BY case_id""")
def evidence_verify_cases(spark, sf_dir):
    """Cases after some files were lost or changed and some manifests too, told apart."""
    files = _files(spark, sf_dir)
    recorded = cases.manifests(files)
    stored = recorded.where("case_id % 13 <> 0").withColumn("manifest", F.when(F.col("case_id") % 6 == 0, F.concat("manifest", F.lit(" "))).otherwise(F.col("manifest")))
    now = files.where("page_id % 11 <> 0").withColumn("content", F.when(F.col("page_id") % 7 == 0, F.concat("content", F.lit(b"!"))).otherwise(F.col("content")))
    return cases.verdicts(cases.verified(recorded, stored, now))


@query("WITH " + _FILES + """, sizes AS (SELECT case_id, sum(bytes) AS bytes FROM files GROUP BY case_id), upto AS (SELECT *, sum(bytes) OVER (ORDER BY case_id) AS upto, sum(bytes) OVER () AS total FROM sizes)
SELECT case_id, role, path FROM files JOIN upto u USING (case_id) WHERE u.upto - u.bytes < total // 2""")
def sink_evidence_limit(spark, sf_dir):
    """The files that a store of half of all bytes takes, in order of the cases' times."""
    files = _files(spark, sf_dir)
    total = files.agg(F.sum(F.length("content"))).first()[0] or 0
    return cases.within_limit(files, total // 2).select("case_id", "role", "path")
