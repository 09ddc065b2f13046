"""Evidence by cases: a manifest for each case's files by role, a tree of hashes over all manifests, and their verification.

A manifest holds one case's few files. The tree has a node for each prefix of the cases' hashes and one root; a node hashes
its children in order, so that no row holds more than a node's children and a changed case shows in one path of the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.operators.stretches import running

#: The roles of a case's files, in the order of a manifest.
ROLES = ("vehicle", "plate", "detection", "before", "after")
#: Hexadecimal digits of the deepest nodes of the tree: 65,536 of them, so that 10^10 cases are some 150,000 lines a node.
DIGITS = 4


def within_limit(files: DataFrame, most_bytes: int, used: int = 0) -> DataFrame:
    """Files (case_id, t, role, content) of the cases that are begun, in order of time, before the store is full.

    A case is written whole if what was used before it, other cases' bytes included, is below ``most_bytes``; later ones are
    left out. Cases without content have no files. Sizes are summed by stretches of time, not in one task.
    """
    some = files.where("content is not null")
    sizes = some.groupBy("case_id").agg(F.min("t").cast("double").alias("t"), F.sum(F.length("content")).alias("bytes")).withColumn("event_id", F.col("case_id"))
    begun = running(sizes, [], "bytes", "upto").where(F.col("upto") - F.col("bytes") + used < most_bytes)
    return some.join(begun.select("case_id"), "case_id", "left_semi")


def manifests(files: DataFrame) -> DataFrame:
    """case_id, manifest (JSON of its files in order of role: role, path, sha256, bytes) and manifest_sha256.

    Of files with one case and role the one with the least path counts; roles that aren't known and null contents are left out.
    """
    order = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role"))
    known = files.where(F.col("role").isin(*ROLES) & F.col("content").isNotNull())
    one = F.struct(order.alias("o"), "role", "path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("bytes"))
    # By role first, so that a case has five files at most when they are put together.
    each = known.groupBy("case_id", "role").agg(F.min_by(one, "path").alias("f"))
    listed = F.transform(F.array_sort(F.collect_list("f")), lambda f: F.struct(*[f[c].alias(c) for c in ("role", "path", "sha256", "bytes")]))
    text = F.to_json(F.struct("case_id", "files"))
    return each.groupBy("case_id").agg(listed.alias("files")).select("case_id", text.alias("manifest")).withColumn("manifest_sha256", F.sha2("manifest", 256))


def _node(name: Column, child: Column) -> Column:
    """Aggregate: the hash of a node's children in order of their names."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(name.alias("n"), child.alias("h")))), lambda x: F.concat_ws(" ", x["n"], x["h"]))
    return F.sha2(F.array_join(lines, "\n"), 256)


def tree(made: DataFrame, digits: int = DIGITS) -> DataFrame:
    """prefix, sha256 and cases of each node over ``manifests``: of prefixes of ``digits`` digits down to none, which is the root.

    The deepest level is one shuffle; each level above has a sixteenth of the rows of the one below. Empty: no rows.
    """
    case = F.col("case_id").cast("string")
    level = made.groupBy(F.substring(F.sha2(case, 256), 1, digits).alias("prefix")).agg(_node(case, F.col("manifest_sha256")).alias("sha256"), F.count("*").alias("cases"))
    out = level
    for n in range(digits - 1, -1, -1):
        level = level.groupBy(F.substring("prefix", 1, n).alias("prefix")).agg(_node(F.col("prefix"), F.col("sha256")).alias("sha256"), F.sum("cases").alias("cases"))
        out = out.unionByName(level)
    return out


def written(files: DataFrame, path: str, digits: int = DIGITS) -> None:
    """Files, manifests and tree below ``path``, in this order: where the tree is, the others are whole."""
    spark = files.sparkSession
    files.select("case_id", "role", "path", "content").write.mode("overwrite").parquet(f"{path}/files")
    manifests(spark.read.parquet(f"{path}/files")).write.mode("overwrite").parquet(f"{path}/manifests")
    tree(spark.read.parquet(f"{path}/manifests"), digits).coalesce(1).write.mode("overwrite").parquet(f"{path}/tree")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, manifests and tree that ``written`` has put below ``path``."""
    return tuple(spark.read.parquet(f"{path}/{x}") for x in ("files", "manifests", "tree"))


_FILES = "case_id string, files array<struct<role: string, path: string, sha256: string, bytes: long>>"


def verified(recorded: DataFrame, stored: DataFrame, files: DataFrame) -> DataFrame:
    """case_id, role, state of the file and of the manifest, by what was recorded (case_id, manifest, manifest_sha256).

    ``stored`` has the manifests as they are now. A manifest is ``ok``, ``changed`` or ``missing``; files are held to the
    recorded one and are ``ok``, ``changed`` or ``missing``, or ``unlisted`` if it doesn't name them. A recorded manifest
    that isn't that of its own hash is ``changed`` too, and a case that wasn't recorded ``unlisted``.
    """
    now = stored.select("case_id", F.sha2("manifest", 256).alias("_now"))
    own = F.sha2("manifest", 256) == F.col("manifest_sha256")
    whole = F.when(F.col("_now").isNull(), "missing").when((F.col("_now") == F.col("manifest_sha256")) & own, "ok").otherwise("changed")
    cases = recorded.join(now, "case_id", "left").select("case_id", "manifest", whole.alias("manifest_state"))
    listed = cases.withColumn("f", F.explode(F.from_json("manifest", _FILES)["files"])).select("case_id", "f.role", "f.sha256")
    there = files.where("content is not null").groupBy("case_id", "role").agg(F.min_by(F.sha2("content", 256), "path").alias("_sha256"))
    state = F.when(F.col("sha256").isNull(), "unlisted").when(F.col("_sha256").isNull(), "missing").when(F.col("sha256") == F.col("_sha256"), "ok").otherwise("changed")
    found = listed.join(there, ["case_id", "role"], "full").select("case_id", "role", state.alias("state"))
    return found.join(cases.drop("manifest"), "case_id", "left").select("case_id", "role", "state", F.coalesce("manifest_state", F.lit("unlisted")).alias("manifest_state"))


def verdicts(found: DataFrame) -> DataFrame:
    """Of each case of ``verified`` whether it is valid, and how many of its files are in each state."""
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    states = [count(s) for s in ("ok", "changed", "missing", "unlisted")]
    return found.groupBy("case_id").agg(F.bool_and((F.col("state") == "ok") & (F.col("manifest_state") == "ok")).alias("valid"), F.max("manifest_state").alias("manifest_state"), *states)


def changed_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Prefixes whose nodes differ between two trees: the paths from the root to the cases that changed."""
    now = after.select("prefix", F.col("sha256").alias("_now"))
    return before.join(now, "prefix", "full").where(~F.col("sha256").eqNullSafe(F.col("_now"))).select("prefix")
