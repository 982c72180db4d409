"""Imports of untyped sheets and lists (J14 J15 J16) and nested-column edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from stepwise.functions.rules import alias_values
from stepwise.functions.timeops import DEFAULT_TZ, as_utc, instant_of, parse_us_date, shift, ts_literal
from stepwise.operators.joins import explode_list


def import_sheet(raw: DataFrame, as_of, *, tz: str = DEFAULT_TZ, header_value: str = "Item",
                 required: str = "string_field_3", prefix_rules: Sequence[tuple[str, str]] = (("Back End %", "Back End"),),
                 mapping: dict[str, str] | None = None) -> DataFrame:
    """Typed document rows from an untyped sheet export.

    Header rows (``header_value`` in field 0) and rows without ``required`` are dropped; an id that is
    no integer stops the import, as the plain CAST does (ANSI mode); the row timestamp is ``as_of - 1 day + id seconds`` (deterministic per row);
    category prefixes collapse to one label; ``M/d/yy`` dates parse safely in the local zone.
    """
    m = {"team_center_doc_id": "string_field_4", "status": "string_field_5", "priority": "string_field_6",
         "link_to_working_copy": "string_field_12", "file_name": "string_field_13", "notes": "string_field_18",
         "department": "string_field_3", "fe_be": "string_field_2", "due_date": "string_field_7", "id": "string_field_0"}
    m.update(mapping or {})
    keep = (F.col(m["id"]) != F.lit(header_value)) & F.col(required).isNotNull()
    r = raw.filter(keep)
    ident = F.col(m["id"]).cast("bigint")
    base = ts_literal(as_utc(as_of), None)
    ts = shift(shift(base, -1, "DAY"), ident, "SECOND")
    fe = F.col(m["fe_be"])
    fe_expr = None
    for pattern, label in prefix_rules:
        fe_expr = F.when(fe.like(pattern), F.lit(label)) if fe_expr is None else fe_expr.when(fe.like(pattern), F.lit(label))
    fe_expr = fe if fe_expr is None else fe_expr.otherwise(fe)
    return r.select(ident.alias("id"), ts.alias("timestamp"), fe_expr.alias("fe_be"),
                    F.col(m["department"]).alias("department"), F.col(m["team_center_doc_id"]).alias("team_center_doc_id"),
                    F.col(m["status"]).alias("status"), F.col(m["priority"]).alias("priority"),
                    instant_of(parse_us_date(m["due_date"]), tz).alias("due_date"),
                    F.col(m["link_to_working_copy"]).alias("link_to_working_copy"),
                    F.col(m["file_name"]).alias("file_name"), F.col(m["notes"]).alias("notes"))


def resolve_people(raw: DataFrame, users: DataFrame, *, aliases: dict[str, str] | DataFrame | None = None,
                   name_field: str = "string_field_16", id_field: str = "string_field_0", header_value: str = "Item",
                   required: str = "string_field_3", unknown: str = "?", role: str = "Owner",
                   active: bool = True) -> DataFrame:
    """Owner rows (doc id, user id) by case-insensitive ``first last`` match after alias mapping.

    Spelling variants map through ``aliases`` (a small dict becomes a CASE; a DataFrame with
    columns ``name, canonical`` is joined). Unmatched names are dropped.
    """
    r = raw.filter((F.col(id_field) != F.lit(header_value)) & F.col(required).isNotNull()
                   & F.col(name_field).isNotNull() & (F.col(name_field) != F.lit(unknown)))
    r = r.select(F.col(id_field).cast("bigint").alias("id"), F.col(name_field).alias("_name"))
    if isinstance(aliases, DataFrame):
        a = aliases.select(F.col(aliases.columns[0]).alias("_alias"), F.col(aliases.columns[1]).alias("_canon"))
        r = r.join(a, r["_name"] == a["_alias"], "left").select(
            "id", F.coalesce(F.col("_canon"), F.col("_name")).alias("_name"))
    elif aliases:
        r = r.select("id", alias_values("_name", aliases).alias("_name"))
    r = r.withColumn("_key", F.lower(F.col("_name")))
    u = users.select("id_user", F.lower(F.concat(F.col("first_name"), F.lit(" "), F.col("last_name"))).alias("_key"))
    j = r.join(u, "_key", "inner")
    return j.select("id", "id_user", F.lit(role).alias("Role"), F.lit(active).alias("active"))


def document_locations(released: DataFrame, docs: DataFrame, *, sep: str = ",", list_col: str = "Site",
                       part_col: str = "Part_Number") -> DataFrame:
    """One row per listed location (not trimmed), left-joined to the document id by part number."""
    rows = explode_list(released.select(part_col, list_col), list_col, sep, name="Loc")
    d = docs.select(F.col("id"), F.col("team_center_doc_id").alias("_doc"))
    j = rows.join(d, rows[part_col] == d["_doc"], "left")
    return j.select("id", "Loc")


def add_struct_field(df: DataFrame, struct_col: str, field: str, data_type: DataType | str,
                     order: Sequence[str] | None = None) -> DataFrame:
    """Rebuild ``struct_col`` with one more (typed null) field, fields in an explicit order.

    Consumers that read struct fields by position need the order fixed, so the struct is rebuilt
    from named fields rather than appended to.
    """
    st = df.schema[struct_col].dataType
    if not isinstance(st, StructType):
        raise TypeError(f"{struct_col} is not a struct")
    names = [f.name for f in st.fields]
    order = list(order) if order else names + [field]
    parts = []
    for n in order:
        if n == field:
            parts.append(F.lit(None).cast(data_type).alias(n))
        elif n in names:
            parts.append(F.col(f"{struct_col}.{n}").alias(n))
        else:
            raise ValueError(f"unknown field {n}")
    others = [c for c in df.columns if c != struct_col]
    return df.select(*others, F.struct(*parts).alias(struct_col))
