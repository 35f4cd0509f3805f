"""Catalog tables: manifests with parameters and places, collections, path templates and work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_parameters(manifests: DataFrame, workflow: str, parameters: dict[str, str]) -> DataFrame:
    """Manifests of a workflow whose parameters include the given ones."""
    found = manifests.where(F.col("workflow") == workflow)
    for k, v in parameters.items():
        found = found.where(F.coalesce(F.try_element_at("parameters", F.lit(k)) == v, F.lit(False)))
    return found


def one_manifest(manifests: DataFrame, workflow: str, parameters: dict[str, str]) -> str:
    """The name of the only one; ValueError for none or several."""
    names = [r.name for r in with_parameters(manifests, workflow, parameters).select("name").distinct().limit(2).collect()]
    if len(names) != 1:
        raise ValueError(f"{'no' if not names else 'more than one'} manifest of {workflow} has these parameters")
    return names[0]


def location_of(manifests: DataFrame, name: str, key: str) -> str:
    """The place of a key; KeyError if there is none."""
    row = locations(manifests).where((F.col("name") == name) & (F.col("key") == key)).first()
    if row is None:
        raise KeyError(key)
    return row.place


def locations(manifests: DataFrame) -> DataFrame:
    """(name, key, place) of all keys that have a place: the first of id, path and uri."""
    return manifests.select("name", "key", F.coalesce("id", "path", "uri").alias("place")).where("place is not null")


def located_keys(manifests: DataFrame) -> DataFrame:
    return manifests.where("coalesce(id, path, uri) is not null").select("name", "key").distinct()


def expand_template(template: Column, values: dict[str, Column], strict: bool = True) -> Column:
    """A template with ``{{name}}`` replaced by values; a name left over gives null, or an error if strict."""
    out = template
    for name, value in values.items():
        out = F.coalesce(F.replace(out, F.lit("{{" + name + "}}"), value.cast("string")), out)
    left = out.contains("{{")
    return F.when(~left, out).otherwise(F.raise_error(F.concat(F.lit("a value is missing for "), out)).cast("string") if strict else F.lit(None))


def members_of(collections: DataFrame, names: list[str], ordered: bool = False) -> DataFrame:
    """Distinct members of collections with their first place: in the order of the names and the lists, or sorted."""
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("name"))
    rows = collections.where(F.col("name").isin(names)).select(rank.alias("r"), F.posexplode("members").alias("i", "dataset"))
    first = rows.groupBy("dataset").agg(F.min(F.struct("r", "i")).alias("s"))
    order = Window.orderBy("dataset") if ordered else Window.orderBy("s")  # a handful of names
    return first.select("dataset", F.row_number().over(order).alias("place"))


def plane_bounds(center: Column, lower: int, upper: int, last: int = 24) -> tuple[Column, Column]:
    return F.greatest(F.lit(0), center - lower), F.least(F.lit(last), center + upper)


def per_frame(df: DataFrame, frames: Column, start: Column, stop: Column, step: Column) -> DataFrame:
    """One row a frame: of the list of frames if there is one, else of the range."""
    return df.withColumn("frame_number", F.explode(F.coalesce(frames, F.sequence(start, stop, step))))


def work_list(positions: DataFrame, duration: Column, step: int, validation_every: int) -> DataFrame:
    """Every step-th frame of each position, with a flag on every n-th of these."""
    rows = positions.withColumn("frame_number", F.explode(F.sequence(F.lit(0), duration - 1, F.lit(step))))
    return rows.withColumn("is_validation", F.pmod(F.floor(F.col("frame_number") / step), F.lit(validation_every)) == 0)
