"""School-pair cases: every image two schools share, with the evidence around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprise.functions import hashing, images, text
from reprise.operators import groups, skew
from reprise.session import materialise

PAIR = ["inep_a", "inep_b"]
SIDE = ("uf", "fornecedor", "fase", "pdf_filename", "pdf_url", "pagina", "thumb_url", "sha256", "width", "height")


def case_images(member_rows: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per (pair, group): the shared image, with the representative of either school."""
    payload = [*SIDE, "grupo_id", "grupo_fornecedor"]
    reps = materialise(
        groups.representatives(member_rows, "grupo_seq", payload, schools_only=True), "representatives")
    pairs = skew.within_key_pairs(reps, ["grupo_seq"], "inep", payload)
    rows = pairs.select(
        F.col("a.inep").alias("inep_a"), F.col("b.inep").alias("inep_b"), "grupo_seq",
        F.col("a.grupo_id").alias("grupo_id"), F.col("a.grupo_fornecedor").alias("grupo_fornecedor"),
        F.col("a.sha256").alias("sha256"), (F.col("a.sha256") == F.col("b.sha256")).alias("exata"),
        F.when(F.col("a.sha256") == F.col("b.sha256"), hashing.EXACT_LABEL).otherwise(hashing.CASE_VISUAL_LABEL)
        .alias("tipo"),
        F.col("a.width").alias("largura"), F.col("a.height").alias("altura"),
        images.camera_aspect(F.col("a.width"), F.col("a.height")).alias("foto_camera"),
        F.col("a.thumb_url").alias("thumb_a"), F.col("b.thumb_url").alias("thumb_b"),
        F.col("a.pagina").alias("pagina_a"), F.col("b.pagina").alias("pagina_b"), "a", "b",
    )
    named = rows.join(classes.select("sha256", "classe"), "sha256", "left").withColumn(
        "classe", F.coalesce("classe", F.lit(images.UNDEFINED)))
    return named.withColumns({
        "classe_rotulo": images.class_label(F.col("classe")), "evidencia": images.is_evidence(F.col("classe")),
    })


def case_pdfs(case_rows: DataFrame, geo: DataFrame) -> DataFrame:
    """One row per (pair, side, PDF) with its pages, the school in its name and its geographic summary."""
    sides = case_rows.select(*PAIR, "grupo_seq", F.inline(F.array(
        F.struct(F.lit("a").alias("lado"), F.col("inep_a").alias("inep"), F.col("a.pdf_url").alias("pdf_url"),
                 F.col("a.pdf_filename").alias("pdf_filename"), F.col("a.pagina").alias("pagina")),
        F.struct(F.lit("b").alias("lado"), F.col("inep_b").alias("inep"), F.col("b.pdf_url").alias("pdf_url"),
                 F.col("b.pdf_filename").alias("pdf_filename"), F.col("b.pagina").alias("pagina")),
    ))).where("pdf_url <> ''")
    pages = F.sort_array(F.collect_set(F.nullif("pagina", F.lit(0))))
    files = sides.groupBy(*PAIR, "lado", "pdf_url").agg(
        F.min_by(F.struct("pdf_filename", "inep"), "grupo_seq").alias("__f"), pages.alias("paginas"))
    name = text.parse_pdf_name("pdf_filename")
    return (
        files.select(*PAIR, "lado", "pdf_url", "__f.pdf_filename", "__f.inep", "paginas")
        .withColumn("inep_no_nome", name["inep"])
        .withColumn("inep_divergente", text.inep_mismatch(F.col("inep_no_nome"), F.col("inep")))
        .join(geo.select("pdf_url", "fora_do_raio", "com_coordenada", "distancia_max_m"), "pdf_url", "left")
    )


def _side(prefix: str) -> Column:
    name = text.parse_pdf_name(F.col(f"{prefix}.pdf_filename"))
    blank = lambda c: F.coalesce(F.col(f"{prefix}.{c}"), F.lit(""))
    return F.struct(
        blank("uf").alias("uf"), name["municipio"].alias("municipio"), name["escola"].alias("escola"),
        blank("fornecedor").alias("fornecedor"), blank("fase").alias("fase"),
    )


def case_table(case_rows: DataFrame, pdfs: DataFrame, marks: DataFrame, forwarded: DataFrame) -> DataFrame:
    """The wide fact row per pair. ``marks`` is keyed by par_id, ``forwarded`` holds par_id, inep_a, inep_b of all lots.

    Images and PDFs are aggregated on the same pair key, so their join needs no further shuffle. Lists on the row are
    bounded by dimensions: classes, supplier names, PDFs of a school. Group ids stay in the image rows.
    """
    supplier_parts = F.flatten(F.collect_set(F.split("grupo_fornecedor", "/")))
    facts = case_rows.groupBy(*PAIR).agg(
        F.min_by(F.struct(_side("a").alias("escola_a"), _side("b").alias("escola_b")), "grupo_seq").alias("__lado"),
        F.sort_array(F.array_distinct(F.filter(F.transform(supplier_parts, text.strip), lambda n: n != "")))
        .alias("fornecedores"),
        F.count(F.lit(1)).alias("qtd_imagens"), F.count_if("exata").alias("qtd_exatas"),
        F.count_if("foto_camera").alias("qtd_fotos_camera"), F.count_if("evidencia").alias("qtd_evidencias"),
        F.count_if(F.col("classe") == images.UNDEFINED).alias("qtd_indefinidas"),
        F.sort_array(F.collect_set("classe")).alias("classes"),
    )
    by_file = pdfs.groupBy(*PAIR, "pdf_url").agg(
        F.bool_or("inep_divergente").alias("divergente"), F.count(F.lit(1)).alias("lados"),
        F.sum(F.coalesce("fora_do_raio", F.lit(0))).alias("fora"),
        F.sum(F.coalesce("com_coordenada", F.lit(0))).alias("com"), F.max("distancia_max_m").alias("dist"),
        F.min(F.when(F.col("lado") == "a", F.col("pdf_filename"))).alias("nome_a"),
        F.min(F.when(F.col("lado") == "b", F.col("pdf_filename"))).alias("nome_b"),
    )

    def names(column: str) -> Column:
        listed = F.sort_array(F.collect_list(F.when(
            F.col(column).isNotNull(), F.struct(F.col("pdf_url"), F.col(column).alias("nome")))))
        return F.transform(listed, lambda x: x["nome"])

    files = by_file.groupBy(*PAIR).agg(
        F.bool_or("divergente").alias("pdf_divergente"), F.sum("fora").alias("fora_do_raio"),
        F.sum("com").alias("com_coordenada"), F.coalesce(F.max("dist"), F.lit(0.0)).alias("distancia_max_m"),
        F.bool_or(F.col("lados") > 1).alias("mesmo_pdf"), names("nome_a").alias("nomes_pdf_a"),
        names("nome_b").alias("nomes_pdf_b"),
    )
    none = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    pairs = facts.join(files, PAIR, "left").select(
        text.pair_id(F.col("inep_a"), F.col("inep_b")).alias("par_id"), *PAIR,
        *[F.col(f"__lado.escola_{s}.{c}").alias(f"{c}_{s}")
          for s in "ab" for c in ("uf", "municipio", "escola", "fornecedor", "fase")],
        "fornecedores", "qtd_imagens", "qtd_exatas", "qtd_fotos_camera", "qtd_evidencias", "qtd_indefinidas", "classes",
        (F.col("qtd_exatas") == F.col("qtd_imagens")).alias("todas_exatas"),
        ((F.col("qtd_evidencias") == 0) & (F.col("qtd_indefinidas") == 0)).alias("so_material_comum"),
        none("pdf_divergente", False).alias("pdf_divergente"), none("mesmo_pdf", False).alias("mesmo_pdf"),
        none("fora_do_raio", 0).alias("fora_do_raio"), none("com_coordenada", 0).alias("com_coordenada"),
        none("distancia_max_m", 0.0).alias("distancia_max_m"), "nomes_pdf_a", "nomes_pdf_b",
    ).withColumns({
        "mesmo_municipio": (F.col("municipio_a") != "") & (F.col("municipio_a") == F.col("municipio_b")),
        "mesma_uf": F.col("uf_a") == F.col("uf_b"),
    })
    return with_forwarded(with_marks(pairs, marks), forwarded)


def with_marks(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    judged = marks.select(
        "par_id", *[F.col(c).alias(f"__{c}") for c in ("falso_positivo", "mae_filho", "motivo_codigo", "motivo", "marcado_em")])
    blank = lambda c: F.coalesce(F.col(f"__{c}"), F.lit(""))
    return pairs.join(judged, "par_id", "left").withColumns({
        "falso_positivo": F.coalesce("__falso_positivo", F.lit(False)),
        "mae_filho": F.coalesce("__mae_filho", F.lit(False)),
        "motivo_codigo": blank("motivo_codigo"), "motivo": blank("motivo"), "marcado_em": blank("marcado_em"),
    }).drop("__falso_positivo", "__mae_filho", "__motivo_codigo", "__motivo", "__marcado_em")


def with_forwarded(pairs: DataFrame, forwarded: DataFrame) -> DataFrame:
    """Flag pairs that are in any lot, or one of whose schools is."""
    sent = forwarded.select("par_id").distinct().withColumn("__sent", F.lit(True))
    schools = forwarded.select(F.explode(F.array("inep_a", "inep_b")).alias("inep")).where(groups.is_school()).distinct()
    out = pairs.join(sent, "par_id", "left")
    for s in "ab":
        out = out.join(schools.select(F.col("inep").alias(f"inep_{s}"), F.lit(True).alias(f"__sent_{s}")), f"inep_{s}", "left")
    return out.withColumn(
        "ja_encaminhado", F.coalesce("__sent", "__sent_a", "__sent_b", F.lit(False))).drop("__sent", "__sent_a", "__sent_b")


def _joined(*columns: str) -> Column:
    return F.concat_ws(" ", *columns)


def search_text() -> Column:
    return F.lower(_joined(
        "inep_a", "inep_b", "escola_a", "municipio_a", "uf_a", "fornecedor_a", "escola_b", "municipio_b", "uf_b",
        "fornecedor_b", "nomes_pdf_a", "nomes_pdf_b"))


def file_text() -> Column:
    return F.lower(_joined("nomes_pdf_a", "nomes_pdf_b"))


def _count(value) -> int:
    try:
        return int(value or 0)
    except (TypeError, ValueError):
        return 0


def case_predicate(
    busca: str = "", contem: str = "", nao_contem: str = "", uf: str = "", municipio: str = "", fornecedor: str = "",
    tipo: str = "", falso_positivo: str = "", encaminhado: str = "", mae_filho: str = "", min_imagens=0,
    somente_fotos="", mesmo_municipio: str = "", evidencia: str = "", gravidade: str = "",
) -> Column:
    """One predicate for all panel filters; an empty value leaves its filter out."""
    lowered = {k: v.strip().lower() for k, v in dict(
        busca=busca, contem=contem, nao_contem=nao_contem, municipio=municipio, fornecedor=fornecedor).items()}
    tests: list[Column] = []
    if lowered["busca"]:
        tests.append(search_text().contains(lowered["busca"]))
    if lowered["contem"]:
        tests.append(file_text().contains(lowered["contem"]))
    if lowered["nao_contem"]:
        tests.append(~file_text().contains(lowered["nao_contem"]))
    if uf.strip():
        tests.append((F.col("uf_a") == uf.strip().upper()) | (F.col("uf_b") == uf.strip().upper()))
    if lowered["municipio"]:
        tests.append((F.lower("municipio_a") == lowered["municipio"]) | (F.lower("municipio_b") == lowered["municipio"]))
    if lowered["fornecedor"]:
        tests.append(F.exists("fornecedores", lambda n: F.lower(n).contains(lowered["fornecedor"])))
    exact = {"exatas": True, "visuais": False}.get(tipo.strip())
    if exact is not None:
        tests.append(F.col("todas_exatas") == exact)
    for value, column in ((falso_positivo, "falso_positivo"), (encaminhado, "ja_encaminhado"), (mae_filho, "mae_filho")):
        wanted = {"ocultar": False, "somente": True}.get(value.strip())
        if wanted is not None:
            tests.append(F.col(column) == wanted)
    if _count(min_imagens) > 1:
        tests.append(F.col("qtd_imagens") >= _count(min_imagens))
    if str(somente_fotos or "").lower() in ("1", "true", "sim"):
        tests.append(F.col("qtd_fotos_camera") > 0)
    same_city = {"sim": True, "nao": False}.get(mesmo_municipio.strip())
    if same_city is not None:
        tests.append(F.col("mesmo_municipio") == same_city)
    if evidencia.strip() == "com_foto":
        tests.append((F.col("qtd_evidencias") > 0) | (F.col("qtd_indefinidas") > 0))
    elif evidencia.strip() == "sem_foto":
        tests.append(F.col("so_material_comum"))
    severity = {
        "fora_do_raio": F.col("fora_do_raio") > 0, "mesmo_pdf": F.col("mesmo_pdf"), "pdf_divergente": F.col("pdf_divergente"),
    }.get(gravidade.strip())
    if severity is not None:
        tests.append(severity)
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


def filter_cases(pairs: DataFrame, **options) -> DataFrame:
    return pairs.where(case_predicate(**options))


CASE_ORDER = ("qtd_evidencias", "qtd_imagens")


def case_order() -> list[Column]:
    return [*[F.desc(c) for c in CASE_ORDER], F.col("inep_a"), F.col("inep_b")]


def case_summary(pairs: DataFrame) -> DataFrame:
    """One row of counters over the (filtered) cases."""
    schools = pairs.select(F.explode(F.array("inep_a", "inep_b")).alias("inep")).distinct().agg(
        F.count(F.lit(1)).alias("escolas"))
    flag = lambda c, name: F.count_if(c).alias(name)
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    counters = pairs.agg(
        F.count(F.lit(1)).alias("pares"), total("qtd_imagens", "imagens"), total("qtd_fotos_camera", "fotos_camera"),
        total("qtd_exatas", "exatas"), total("qtd_evidencias", "evidencias"), flag("so_material_comum", "so_material_comum"),
        flag("falso_positivo", "falsos_positivos"), flag("mae_filho", "mae_filho"),
        flag("ja_encaminhado", "ja_encaminhados"), flag(~F.col("falso_positivo"), "pendentes"),
        flag("mesmo_municipio", "mesmo_municipio"), flag("mesmo_pdf", "mesmo_pdf"),
        flag("pdf_divergente", "pdf_divergente"), flag(F.col("fora_do_raio") > 0, "fora_do_raio"),
    )
    return counters.withColumn("__row", F.lit(1)).join(schools.withColumn("__row", F.lit(1)), "__row").drop("__row")


def cases_by_supplier(pairs: DataFrame) -> DataFrame:
    return (
        pairs.select(F.explode("fornecedores").alias("nome")).groupBy("nome").agg(F.count(F.lit(1)).alias("valor"))
        .orderBy(F.desc("valor"), "nome")
    )


def cases_by_state(pairs: DataFrame) -> DataFrame:
    """Each side counts, so a pair inside one state adds two."""
    return (
        pairs.select(F.explode(F.array("uf_a", "uf_b")).alias("nome")).where("nome <> ''")
        .groupBy("nome").agg(F.count(F.lit(1)).alias("valor")).orderBy(F.desc("valor"), "nome")
    )


def filter_options(pairs: DataFrame) -> DataFrame:
    """Distinct (kind, value) for the selectors."""
    entries = F.concat(
        F.array(*[F.struct(F.lit("uf").alias("tipo"), F.col(c).alias("valor")) for c in ("uf_a", "uf_b")]),
        F.array(*[F.struct(F.lit("municipio").alias("tipo"), F.col(c).alias("valor")) for c in ("municipio_a", "municipio_b")]),
        F.transform("fornecedores", lambda n: F.struct(F.lit("fornecedor").alias("tipo"), n.alias("valor"))),
    )
    return pairs.select(F.inline(entries)).where("valor <> ''").distinct()


# Fixed values ---------------------------------------------------------------------------------------------------------
EXPORT_HEADINGS = (
    "INEP A", "Escola A", "UF A", "Municipio A", "INEP B", "Escola B", "UF B", "Municipio B", "Fornecedor", "Imagens", "Exatas",
    "Fotos de vistoria", "Tipo de evidencia", "Fotos fora do raio", "Distancia max (m)", "Mesmo municipio", "Mesmo PDF nos dois",
    "PDF de outra escola", "Falso positivo", "Grupos", "PDF A", "PDF B",
)
# ----------------------------------------------------------------------------------------------------------------------


def case_export(pairs: DataFrame, case_rows: DataFrame) -> DataFrame:
    """The report columns under their headings. Group ids are gathered here only, for the pairs that are exported."""
    yes_no = lambda c: F.when(F.col(c), "sim").otherwise("nao")
    ids = case_rows.join(pairs.select(*PAIR), PAIR, "left_semi").groupBy(*PAIR).agg(
        F.array_join(F.sort_array(F.collect_set("grupo_id")), " ").alias("__grupos"))
    rows = pairs.join(ids, PAIR)
    columns = [
        *[F.col(f"{c}_{side}") for side in "ab" for c in ("inep", "escola", "uf", "municipio")],
        F.array_join("fornecedores", " / "), *[F.col(c) for c in ("qtd_imagens", "qtd_exatas", "qtd_evidencias")],
        F.array_join(F.transform("classes", images.class_label), " / "), F.col("fora_do_raio"),
        F.bround("distancia_max_m", 0).cast("bigint"),
        *[yes_no(c) for c in ("mesmo_municipio", "mesmo_pdf", "pdf_divergente", "falso_positivo")], F.col("__grupos"),
        F.array_join("nomes_pdf_a", " | "), F.array_join("nomes_pdf_b", " | "),
    ]
    return rows.orderBy(*case_order()).select(*[c.alias(heading) for c, heading in zip(columns, EXPORT_HEADINGS)])
