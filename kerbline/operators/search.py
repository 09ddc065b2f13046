"""Searches: conjunctive filters, partial, fuzzy and pseudonymous plates, watchlists, paging, masked views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.functions.plates import CONFUSABLE, weighted_distance
from kerbline.functions.privacy import pseudonym_prefix


def conditions(since: float | None = None, until: float | None = None, **equal: object) -> Column:
    """All of: t in [since, until], and each named column equal to its value, among a list's values, or unknown for None."""
    found = []
    if since is not None:
        found.append(F.col("t") >= since)
    if until is not None:
        found.append(F.col("t") <= until)
    for name, value in equal.items():
        column = F.col(name)
        found.append(column.isNull() if value is None else column.isin(value) if isinstance(value, (list, tuple)) else column == value)
    return reduce(lambda a, b: a & b, found, F.lit(True))


def sightings(obs: DataFrame, now: float, since: float | None = None, until: float | None = None, least_confidence: float | None = None, unreadable: bool | None = None, **equal: object) -> DataFrame:
    """Sightings of [since, until] (seven days up to now unless given) that fulfil all of the given filters.

    ``unreadable`` asks for sightings without a plate, or, false, for those with one. Further names are columns and the values
    that they equal, such as camera_id, vehicle_class, colour or level.
    """
    until = now if until is None else until
    since = until - 7 * 86_400 if since is None else since
    if since > until:
        raise ValueError("the span's start must not be after its end")
    kept = conditions(since, until, **equal)
    if least_confidence is not None:
        kept &= F.col("confidence") >= least_confidence
    if unreadable is not None:
        kept &= F.col("plate").isNull() if unreadable else F.col("plate").isNotNull()
    return obs.where(kept)


def newest(log: DataFrame, limit: int, offset: int = 0, at: str = "t", ties: str = "event_id", **equal: object) -> DataFrame:
    """A page of a log: the newest rows of those with the given values, ties by the greater ``ties``."""
    return log.where(conditions(**equal)).orderBy(F.desc(at), F.desc(ties)).offset(offset).limit(limit)


def partial_plate(obs: DataFrame, query: str) -> DataFrame:
    """Sightings whose fused or raw plate contains the letters and digits of the query, two at least."""
    kept = "".join(c for c in query.upper() if c.isascii() and c.isalnum())
    if len(kept) < 2:
        raise ValueError("a partial plate needs two characters")
    return obs.where(F.col("plate").contains(kept) | F.col("plate_raw").contains(kept))


def _classes() -> dict[str, str]:
    """Each confusable character and the least of those that a chain of confusions leads to."""
    least = {c: c for pair in CONFUSABLE for c in pair}
    for _ in least:
        for a, b in CONFUSABLE:
            least[a] = least[b] = min(least[a], least[b])
    return least


def deletions(plate: Column, edits: int) -> Column:
    """Keys of a plate: what is left of it without up to ``edits`` of its characters, confusable ones being one."""
    classes = _classes()
    found = F.array(F.translate(plate, "".join(classes), "".join(classes.values())))
    without = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    for _ in range(edits):
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, lambda x: F.when(F.length(x) > 0, without(x)).otherwise(F.array(x))))))
    return found


def near_plates(plates: DataFrame, wanted: DataFrame, most: float) -> DataFrame:
    """Pairs of a plate of ``plates`` and one of ``wanted`` (wanted) within a weighted distance, and the distance d.

    By deletions: texts within n edits have a key in common when up to n characters of each are left out, and a confusion
    is no edit between keys. So pairs meet by equal keys, whatever the lengths, and only those that meet are measured.
    """
    edits = int(most + 1e-9)
    keyed = plates.select("plate").where("plate is not null").distinct().select("plate", F.explode(deletions(F.col("plate"), edits)).alias("_key"))
    asked = wanted.select("wanted").distinct().select("wanted", F.explode(deletions(F.col("wanted"), edits)).alias("_key"))
    met = keyed.join(asked, "_key").select("plate", "wanted").distinct()
    return met.withColumn("d", weighted_distance("plate", "wanted")).where(F.col("d") <= most + 1e-9)


def fuzzy_plate(obs: DataFrame, target: str, most: float = 1.5, band: int = 2) -> DataFrame:
    """Sightings with plates within a weighted distance of the target, of lengths within ``band``, and the distance to two digits."""
    wanted = obs.sparkSession.createDataFrame([(target,)], "wanted string")
    found = near_plates(obs, wanted, most).where(F.abs(F.length("plate") - len(target)) <= band)
    return obs.join(found.select("plate", F.round("d", 2).alias("plate_distance")), "plate")


def by_pseudonym(obs: DataFrame, query: str, hashed: str = "plate_hash") -> DataFrame:
    prefix = pseudonym_prefix(query)
    return obs.where(F.lit(False) if prefix is None else F.col(hashed).startswith(prefix))


def text_search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows with the text in any of the columns, whatever its case."""
    literal = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return df.where(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{literal}%") for c in columns]))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order; the order must end in a unique column."""
    return df.orderBy(*order).offset(offset).limit(limit)


def active_entries(entries: DataFrame, now: float) -> DataFrame:
    return entries.where(F.col("active") & (F.col("expires_s").isNull() | (F.col("expires_s") > now)))


def watchlist_matches(obs: DataFrame, entries: DataFrame, most: float = 1.0) -> DataFrame:
    """Sightings that match an entry: the same plate, or for fuzzy entries within a weighted distance (lengths within one).

    Exact matches are an equi-join; distinct plates find fuzzy ones by ``near_plates``. No sighting is compared with an entry itself.
    """
    listed = entries.select("entry_id", F.col("plate").alias("entry_plate"), "match_mode", "priority")
    exact = obs.join(listed.withColumn("plate", F.col("entry_plate")), "plate").withColumn("distance", F.lit(0.0))
    fuzzy = listed.where("match_mode = 'fuzzy'")
    near = near_plates(obs, fuzzy.select(F.col("entry_plate").alias("wanted")), most).where((F.col("plate") != F.col("wanted")) & (F.abs(F.length("plate") - F.length("wanted")) <= 1))
    near = near.join(fuzzy, F.col("wanted") == F.col("entry_plate")).drop("wanted")
    return exact.unionByName(obs.join(near, "plate").withColumn("distance", F.round("d", 2)).drop("d"))


def retrospective(obs: DataFrame, entries: DataFrame, since: float, most: float = 1.0, limit: int = 200) -> DataFrame:
    """Of each entry the newest ``limit`` matching sightings since a time."""
    newest = Window.partitionBy("entry_id").orderBy(F.desc("t"), F.desc("event_id"))
    return watchlist_matches(obs.where(F.col("t") >= since), entries, most).withColumn("n", F.row_number().over(newest)).where(F.col("n") <= limit).drop("n")


def visible_events(events: DataFrame, types: list[str], permitted: list[str], raw: bool) -> DataFrame:
    """Events of subscribed and permitted types; plates are blanked for those who may not see them."""
    kept = events.where(F.col("type").isin(types) & F.col("type").isin(permitted))
    return kept if raw else kept.withColumn("plate", F.lit(None).cast("string"))
