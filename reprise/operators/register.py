"""School register: typed rows from an export, differences to the current state, and the merged result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprise.functions import text

COMPARED = (
    "inep", "uf", "fornecedor", "tipo_fornecedor", "status_geral", "fase", "books", "atualizacao",
    "ativacao_rede_externa", "ativacao_rede_interna",
)


def column_like(df: DataFrame, fragment: str) -> str:
    """Name of the column that contains the fragment, whatever its case or accents around it."""
    for name in df.columns:
        if fragment.lower() in name.lower():
            return name
    raise KeyError(fragment)


def typed_export(raw: DataFrame) -> DataFrame:
    """All-text export rows as register rows, without a key yet."""
    supplier = text.supplier_composition("fornecedor_ri", "fornecedor_re")
    whole = F.regexp_replace(text.strip("INEP"), r"\.0$", "")
    return raw.withColumn("__s", supplier).select(
        whole.try_cast("bigint").alias("inep"), F.upper(text.strip("UF")).alias("uf"), F.col("__s.nome").alias("fornecedor"),
        F.col("__s.tipo").alias("tipo_fornecedor"), text.status_or_default("Status Geral").alias("status_geral"),
        text.normalise_phase("FASE").alias("fase"), text.parse_books("Books").alias("books"),
        text.parse_date("Atualizacao").alias("atualizacao"),
        text.parse_date(F.col(f"`{column_like(raw, 'Rede externa')}`")).alias("ativacao_rede_externa"),
        text.parse_date(F.col(f"`{column_like(raw, 'Rede interna')}`")).alias("ativacao_rede_interna"),
    )


def one_per_school(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Deterministic last row per school id, so an upsert never meets the same key twice.

    Rows without an id are no school; :func:`rejected_rows` has them.
    """
    rest = [c for c in rows.columns if c != "inep"]
    return rows.where("inep is not null").groupBy("inep").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(
        "inep", "__r.*").select(*rows.columns)


def rejected_rows(rows: DataFrame) -> DataFrame:
    """Export rows without a school id, each kept, to be looked at by hand: no key could be built for an upsert."""
    return rows.where("inep is null")


def changed_fields(new: str, old: str) -> Column:
    """Names of the fields that differ; lists by value, timestamps to the second."""
    tests = []
    for c in COMPARED:
        a, b = F.col(f"{new}.{c}"), F.col(f"{old}.{c}")
        if c == "books":
            empty = F.array().cast("array<string>")
            a, b = F.coalesce(a, empty), F.coalesce(b, empty)
        elif c.startswith("a"):
            a, b = F.date_trunc("second", a), F.date_trunc("second", b)
        tests.append(F.when(~a.eqNullSafe(b), F.lit(c)))
    return F.filter(F.array(*tests), lambda c: c.isNotNull())


def register_diff(export: DataFrame, current: DataFrame, key_prefix: str = "inep_") -> DataFrame:
    """One row per school of either side: ``acao`` novo / alterado / igual / orfao, the changed fields and the new row."""
    # A null id never matches: such an export row is an insert, such a register row is no orphan.
    known = current.where("inep is not null and inep <> 0")
    joined = export.alias("n").join(known.alias("c"), F.col("n.inep") == F.col("c.inep"), "full_outer")
    in_export, in_current = F.col("n.status_geral").isNotNull(), F.col("c.escola_id_bubble").isNotNull()
    fields = F.when(in_export & in_current, changed_fields("n", "c")).otherwise(F.array().cast("array<string>"))
    return joined.select(
        F.when(~in_current, "novo").when(~in_export, "orfao").when(F.size(fields) > 0, "alterado").otherwise("igual")
        .alias("acao"),
        fields.alias("campos"),
        text.register_key(F.col("c.escola_id_bubble"), F.col("n.inep"), key_prefix).alias("escola_id_bubble"),
        *[F.when(in_export, F.col(f"n.{c}")).otherwise(F.col(f"c.{c}")).alias(c) for c in COMPARED],
    )


def rows_to_send(diff: DataFrame, only_changes: bool = True) -> DataFrame:
    """Changed and new rows, or every export row."""
    actions = ("alterado", "novo") if only_changes else ("alterado", "novo", "igual")
    return diff.where(F.col("acao").isin(*actions)).drop("acao", "campos")


def merged_register(current: DataFrame, sent: DataFrame) -> DataFrame:
    """State after the upsert: sent rows replace those with their key, everything else (orphans too) stays."""
    return upsert(current, sent.select(*current.columns), ["escola_id_bubble"])


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Replace by key, insert the rest. Same changes twice give the same state."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def diff_actions(diff: DataFrame) -> DataFrame:
    return diff.groupBy("acao").agg(
        F.count(F.lit(1)).alias("linhas"), F.count_if(F.array_contains("campos", "books")).alias("com_books"))


def diff_fields(diff: DataFrame) -> DataFrame:
    return diff.select(F.explode("campos").alias("campo")).groupBy("campo").agg(F.count(F.lit(1)).alias("linhas"))


def new_by_phase(diff: DataFrame) -> DataFrame:
    return diff.where("acao = 'novo'").groupBy("fase").agg(F.count(F.lit(1)).alias("escolas"))


def orphans(export: DataFrame, current: DataFrame) -> DataFrame:
    """Schools of the register that the export no longer lists; they are reported and kept."""
    return current.where("inep is not null and inep <> 0").join(export.select("inep"), "inep", "left_anti")


def forbidden_phases(export: DataFrame, allowed: str) -> DataFrame:
    """Phases of an export that its single-phase loader must refuse. Any row means stop."""
    return export.where(F.col("fase").isNotNull() & (F.col("fase") != allowed)).select("fase").distinct()


def schools_by_phase(register: DataFrame) -> DataFrame:
    return (
        register.where("fase <> ''").groupBy("fase").agg(F.count(F.lit(1)).alias("escolas"))
        .orderBy(F.desc("escolas"), "fase")
    )


def schools_of_phase(register: DataFrame, phase: str, supplier: str = "") -> DataFrame:
    """Phase filter pushes down to the scan; the supplier text is a contains test."""
    out = register.where(F.col("fase") == phase)
    return schools_of_supplier(out, supplier) if supplier.strip() else out


def schools_of_supplier(register: DataFrame, supplier: str, limit: int | None = None) -> DataFrame:
    out = register.where(F.lower("fornecedor").contains(supplier.strip().lower()))
    return out if limit is None else out.orderBy("inep").limit(limit)


def first_schools(register: DataFrame, n: int) -> DataFrame:
    """Sample mode: the n lowest school ids."""
    return register.orderBy("inep").limit(n)


def pdf_tasks(register: DataFrame) -> DataFrame:
    """One row per (school, PDF)."""
    return register.select(
        "inep", "uf", F.coalesce(F.nullif("fornecedor", F.lit("")), F.lit(text.UNKNOWN_SUPPLIER)).alias("fornecedor"),
        "fase", F.explode("books").alias("__url"),
    ).where("__url <> ''").select(
        "inep", "uf", "fornecedor", "fase", text.absolute_url("__url").alias("pdf_url"),
    ).withColumn("pdf_filename", text.url_file_name("pdf_url"))
