"""Groups of one image seen in several schools of a common supplier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reprise.functions import hashing, text
from reprise.operators import skew
from reprise.session import discard, materialise

MEMBER_ORDER = ("pdf_filename", "pagina", "occ_id")


def is_school(c: Column | str = "inep") -> Column:
    """Null and zero ids never count as a school."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c != 0, F.lit(False))


def shared_clusters(occ: DataFrame, cluster: str = "sha256") -> DataFrame:
    """Clusters seen in two schools or more; min < max settles that with a fixed-size, map-side-combined aggregate."""
    return (
        occ.where(is_school()).groupBy(cluster).agg(F.min("inep").alias("__lo"), F.max("inep").alias("__hi"))
        .where("__lo < __hi").select(cluster)
    )


def school_rows(occ: DataFrame, cluster: Column | str = "sha256") -> DataFrame:
    """Occurrence counts per (cluster, school, supplier field). Members without a school have a null ``escola``: they count as
    occurrences, not schools."""
    return occ.groupBy(cluster, F.nullif("inep", F.lit(0)).alias("escola"), "fornecedor").agg(F.count(F.lit(1)).alias("ocorrencias"))


def cluster_digests(occ: DataFrame, cluster: str = "sha256") -> DataFrame:
    """Number and smallest of the digests of every cluster."""
    if cluster == "sha256":
        return occ.select(cluster).distinct().withColumns({"qtd_shas": F.lit(1).cast("bigint"), "sha256_min": F.col(cluster)})
    return occ.select(cluster, "sha256").distinct().groupBy(cluster).agg(
        F.count("sha256").alias("qtd_shas"), F.min("sha256").alias("sha256_min"))


def common_suppliers(per_school: DataFrame, cluster: str = "sha256") -> DataFrame:
    """Size of every cluster that crosses schools and ``nomes``, the names present in all its schools: relational division by
    counting.

    The names of one school are united first. A school without any name still counts as a school, so nothing covers it.
    Schools of a single field are counted by field before fields are split. Rows are dealt by cluster once, combined as they are: a
    cluster brings at most its schools and their fields to a task, and ``nomes`` is drawn from a list of the names in the cluster.
    """
    fields = F.count(F.lit(1)).over(Window.partitionBy(cluster, "escola"))
    rows = per_school.repartition(cluster).withColumn("__several", F.when(fields > 1, F.col("escola")))
    counted = rows.groupBy(cluster, "__several", "fornecedor").agg(
        F.sum("ocorrencias").alias("ocorrencias"), F.count("escola").alias("__covered"))
    # A null name stands for the cluster itself: all its occurrences and schools.
    names = F.coalesce(F.array_distinct(text.supplier_names("fornecedor")), F.array().cast("array<string>"))
    named = counted.withColumn("nome", F.explode(F.array_prepend(names, F.lit(None).cast("string")))).groupBy(
        cluster, "__several", "nome").agg(
        F.sum("ocorrencias").alias("ocorrencias"),
        F.when(F.col("__several").isNull(), F.sum("__covered")).otherwise(1).alias("__covered"))
    per_name = named.groupBy(cluster, "nome").agg(F.sum("ocorrencias").alias("ocorrencias"), F.sum("__covered").alias("__covered"))
    own = F.col("nome").isNull()
    found = per_name.groupBy(cluster).agg(
        F.max(F.when(own, F.col("ocorrencias"))).alias("qtd_ocorrencias"), F.max(F.when(own, F.col("__covered"))).alias("qtd_ineps"),
        F.collect_list(F.when(~own, F.struct("nome", "__covered"))).alias("__names"))
    everywhere = F.filter("__names", lambda x: x["__covered"] == F.col("qtd_ineps"))
    return found.where("qtd_ineps > 1").select(
        cluster, "qtd_ocorrencias", "qtd_ineps", F.sort_array(F.transform(everywhere, lambda x: x["nome"])).alias("nomes"))


def cluster_facts(occ: DataFrame, cluster: str = "sha256") -> DataFrame:
    """Size, digests and common names of every cluster that crosses schools, written.

    The rows of schools are shuffled twice, to be combined and to meet in their cluster. They carry a number for the cluster;
    its digest comes back when a cluster is one row.
    """
    known = occ.where(F.col(cluster).isNotNull())
    digests = materialise(cluster_digests(known, cluster), "digests")
    number = skew.stand_in(digests, cluster).alias("__cluster")
    facts = common_suppliers(school_rows(known, number), "__cluster")
    out = materialise(skew.shuffled(facts, digests.select("*", number), ["__cluster"]).select(
        cluster, "qtd_ocorrencias", "qtd_ineps", "qtd_shas", "nomes", *([] if cluster == "sha256" else ["sha256_min"])), "facts")
    discard(digests)
    return out


def template_clusters(occ: DataFrame, cluster: str = "sha256") -> DataFrame:
    """Clusters that cross schools but have no supplier in common: logos and forms, not reused evidence."""
    return cluster_facts(occ, cluster).where(F.size("nomes") == 0).drop("nomes")


def group_summary(
    occ: DataFrame, cluster: str = "sha256", same_supplier: bool = True, ignore_templates: bool = True
) -> DataFrame:
    """One row per kept group with its rank id.

    With either switch on a group needs a common supplier; with both off every cross-school cluster is kept and
    ``fornecedor`` may be empty.
    """
    facts = cluster_facts(occ, cluster)
    smallest = "cluster" if cluster == "sha256" else "sha256_min"
    kept = facts.where(F.size("nomes") > 0) if same_supplier or ignore_templates else facts
    rows = kept.withColumnRenamed(cluster, "cluster").withColumn("fornecedor", F.array_join("nomes", " / ")).drop("nomes")
    ranked = skew.ranked(rows, ["qtd_ineps", "qtd_ocorrencias"], smallest, "grupo_seq")
    discard(facts)
    return ranked.select(
        "cluster", "fornecedor", "qtd_ineps", "qtd_ocorrencias", "qtd_shas",
        F.when(F.col("qtd_shas") == 1, hashing.EXACT_LABEL).otherwise(hashing.MIXED_LABEL).alias("tipo"),
        F.col(smallest).alias("sha256_min"), "grupo_seq", group_label(F.col("grupo_seq")).alias("grupo_id"))


def group_label(seq: Column) -> Column:
    return F.format_string("G%05d", seq)


def members(occ: DataFrame, groups: DataFrame, cluster: str = "sha256", columns: Sequence[str] = ()) -> DataFrame:
    """Long table of group members (null-school members included)."""
    kept = groups.select(
        F.col("cluster").alias(cluster), "grupo_id", "grupo_seq", F.col("fornecedor").alias("grupo_fornecedor")
    )
    out = occ.join(kept, cluster)
    return out.select("grupo_id", "grupo_seq", "grupo_fornecedor", *columns) if columns else out


def nest_groups(member_rows: DataFrame) -> DataFrame:
    """Per-group lists for the report. Each list holds distinct dimension values (schools, states, supplier fields), never
    one entry per occurrence; members themselves stay in the long table."""

    def listed(column: str, keep: Column) -> DataFrame:
        return (
            member_rows.where(keep).select("grupo_id", column).distinct().groupBy("grupo_id")
            .agg(F.sort_array(F.collect_list(column)).alias(column))
        )

    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return (
        listed("inep", is_school()).withColumnRenamed("inep", "ineps")
        .join(listed("fornecedor", filled("fornecedor")).withColumnRenamed("fornecedor", "fornecedores"), "grupo_id", "left")
        .join(listed("uf", filled("uf")).withColumnRenamed("uf", "ufs"), "grupo_id", "left")
    )


def representatives(member_rows: DataFrame, key: str, columns: Sequence[str], schools_only: bool) -> DataFrame:
    """First member of each school of a group, by file name and page."""
    rows = member_rows.where(is_school()) if schools_only else member_rows
    payload = F.struct(*[F.col(c) for c in dict.fromkeys([*MEMBER_ORDER, *columns]) if c not in (key, "inep")])
    return (
        rows.groupBy(key, "inep").agg(F.min_by(payload, F.struct(*MEMBER_ORDER)).alias("__rep"))
        .select(key, "inep", "__rep.*")
    )


def shared_representatives(occ: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Representatives per (image, school) of the images that cross schools."""
    return skew.reduce_wanted(
        occ, shared_clusters(occ), "sha256", lambda rows: representatives(rows, "sha256", columns, schools_only=True))


def filter_groups(groups: DataFrame, nested: DataFrame, search: str = "", min_schools: int = 0) -> DataFrame:
    """Group list of a run: minimum number of schools and free text over ids, supplier fields and states."""
    out = groups.join(nested, "grupo_id")
    if min_schools:
        out = out.where(F.col("qtd_ineps") >= min_schools)
    term = search.strip().lower()
    if term:
        haystack = F.concat_ws(
            " ", F.transform("ineps", lambda i: i.cast("string")), "fornecedores", "ufs"
        )
        out = out.where(F.contains(F.lower(haystack), F.lit(term)))
    return out


def run_metrics(
    schools: DataFrame, tasks: DataFrame, occ: DataFrame, groups: DataFrame, member_rows: DataFrame,
    audited: DataFrame, chain: DataFrame, same_supplier: bool = True, stored_rows: DataFrame | None = None,
    stored_pairs: DataFrame | None = None,
) -> DataFrame:
    """One row of run counters. Each input is reduced to one row before the rows are put side by side.

    ``stored_rows`` and ``stored_pairs`` are what the sinks of audited rows and pairs took; they count 0 if nothing was stored.
    """
    suppliers = (
        groups.where("fornecedor <> ''").select("fornecedor") if same_supplier else member_rows.select("fornecedor")
    )
    n = F.count(F.lit(1))
    singles = [
        schools.agg(n.alias("escolas_selecionadas")),
        tasks.agg(n.alias("pdfs_selecionados")),
        occ.agg(n.alias("imagens_extraidas")),
        occ.select("pdf_url").distinct().agg(n.alias("pdfs_com_imagem")),
        occ.select("sha256").distinct().agg(n.alias("imagens_unicas")),
        groups.agg(n.alias("grupos_duplicatas")),
        audited.agg(F.count_if("tem_duplicata").alias("imagens_duplicadas")),
        member_rows.where(is_school()).select("inep").distinct().agg(n.alias("escolas_afetadas")),
        chain.agg(
            n.alias("pares"), F.count_if(F.col("similaridade") == 100.0).alias("pares_exatos"),
            F.count_if(F.col("similaridade") < 100.0).alias("pares_visuais"),
        ),
        suppliers.distinct().agg(n.alias("fornecedores_afetados")),
        *[df.agg(n.alias(name)) for df, name in ((stored_rows, "supabase_analisados"), (stored_pairs, "supabase_pares")) if df is not None],
    ]
    tagged = [s.withColumn("__row", F.lit(1)) for s in singles]
    out = tagged[0]
    for other in tagged[1:]:
        out = out.join(other, "__row")
    out = out.drop("__row")
    for name in ("supabase_analisados", "supabase_pares"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(0).cast("bigint"))
    return out


def metrics_map(metrics: DataFrame) -> DataFrame:
    """The counters as the run record holds them: one map from name to number."""
    return metrics.select(F.create_map(*[x for c in metrics.columns for x in (F.lit(c), F.col(c).cast("bigint"))]).alias("metricas"))


def evidence_images(member_rows: DataFrame) -> DataFrame:
    """Distinct images that appear in any group of a run."""
    return member_rows.groupBy("sha256").agg(F.min("thumb_url").alias("thumb_url"))
