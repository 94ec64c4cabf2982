"""Human triage marks: from change events to the current state of a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------------------------------------------------
REASON_CODES = {
    "mesma_escola": "Mesma escola com dois INEPs",
    "material_comum": "Imagem é material padrão do fornecedor",
    "equipamento_igual": "Equipamento igual, fotos diferentes",
    "erro_sistema": "Erro do sistema de comparação",
    "conferido_ok": "Conferido: fotos realmente distintas",
    "outro": "Outro",
}
# ----------------------------------------------------------------------------------------------------------------------

KEY = ("run_id", "par_id")
STATE = ("falso_positivo", "motivo_codigo", "motivo", "mae_filho", "inep_a", "inep_b", "atualizado_em", "atualizado_por")


def known_reason() -> Column:
    return F.col("motivo_codigo").isNull() | F.col("motivo_codigo").isin("", *REASON_CODES)


def accepted(events: DataFrame) -> DataFrame:
    """Events that name a pair, change something and carry a listed reason code."""
    changes = F.col("falso_positivo").isNotNull() | F.col("mae_filho").isNotNull()
    return events.where(F.coalesce(F.col("par_id") != "", F.lit(False)) & changes & known_reason())


def rejected(events: DataFrame) -> DataFrame:
    changes = F.col("falso_positivo").isNotNull() | F.col("mae_filho").isNotNull()
    return events.where(~(F.coalesce(F.col("par_id") != "", F.lit(False)) & changes & known_reason()))


def current_marks(events: DataFrame) -> DataFrame:
    """Latest state per (run, pair). A null field leaves the stored value alone; unmarking a false positive clears both
    reason fields unless the same event writes them.

    The last event that touched a field decides it, so the fold is a plain max_by per field: combined map-side, no window
    over a hot pair.
    """
    order = F.struct("ts", "seq")

    def last(value: Column, touched: Column) -> Column:
        return F.max_by(value, F.when(touched, order))

    cleared = F.coalesce(~F.col("falso_positivo"), F.lit(False))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    given = lambda c: F.col(c).isNotNull()
    return events.groupBy(*KEY).agg(
        F.coalesce(last(F.col("falso_positivo"), given("falso_positivo")), F.lit(False)).alias("falso_positivo"),
        last(blank("motivo_codigo"), given("motivo_codigo") | cleared).alias("motivo_codigo"),
        last(blank("motivo"), given("motivo") | cleared).alias("motivo"),
        F.coalesce(last(F.col("mae_filho"), given("mae_filho")), F.lit(False)).alias("mae_filho"),
        last(F.col("inep_a"), given("inep_a")).alias("inep_a"), last(F.col("inep_b"), given("inep_b")).alias("inep_b"),
        F.max("ts").alias("atualizado_em"),
        last(F.col("autor"), F.coalesce(F.col("autor") != "", F.lit(False))).alias("atualizado_por"),
    )


def overlay(legacy: DataFrame, stored: DataFrame) -> DataFrame:
    """Old false-positive file as base, stored fields on top. A stored row overrides every field it has."""
    base = legacy.select("par_id", F.col("falso_positivo").alias("__fp"), F.col("marcado_em").alias("__em"))
    return stored.withColumn("__s", F.lit(True)).join(base, "par_id", "full_outer").select(
        "par_id", F.when(F.col("__s"), F.col("falso_positivo")).otherwise(F.col("__fp")).alias("falso_positivo"),
        F.coalesce("mae_filho", F.lit(False)).alias("mae_filho"), "motivo_codigo", "motivo",
        F.coalesce("__em", F.date_format("atualizado_em", "yyyy-MM-dd HH:mm:ss")).alias("marcado_em"),
    )
