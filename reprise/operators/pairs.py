"""Pair rows derived from groups and from raw occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.functions import hashing
from reprise.operators import groups, skew
from reprise.session import materialise

SIDE = ("inep", "uf", "fornecedor", "pdf_filename", "pagina", "thumb_url")


def chain_pairs(member_rows: DataFrame) -> DataFrame:
    """School 1 x 2, 2 x 3, ... inside each group: k - 1 rows instead of k(k - 1)/2.

    The null-school member has a representative too and sorts as school zero.
    """
    payload = [*SIDE, "sha256", "phash"]
    reps = groups.representatives(member_rows, "grupo_id", payload, schools_only=False)
    position = F.coalesce("inep", F.lit(0))
    order = [position, F.col("pdf_filename"), F.col("pagina"), F.col("occ_id")]
    chained = skew.lead_within(
        reps, "grupo_id", position, order, F.struct("inep", *[c for c in payload if c != "inep"]), "b"
    ).where("b is not null")
    same = F.col("sha256") == F.col("b.sha256")
    distance = F.when(same, 0).otherwise(hashing.hamming(F.col("phash"), F.col("b.phash"))).cast("int")
    return chained.select(
        "grupo_id",
        *[F.col(c).alias(f"{c}_a") for c in SIDE], *[F.col(f"b.{c}").alias(f"{c}_b") for c in SIDE],
        F.when(same, hashing.EXACT_LABEL).otherwise(hashing.VISUAL_LABEL).alias("tipo_duplicata"),
        hashing.similarity(distance).alias("similaridade"), distance.alias("distancia_hamming"), "sha256",
    )


def exact_school_pairs(occ: DataFrame) -> DataFrame:
    """One row per image and unordered pair of different schools, whatever the supplier.

    Occurrences shrink to one per (image, school) before the join, and images of a single school are gone by then.
    """
    reps = materialise(groups.shared_representatives(occ, SIDE), "representatives")
    pairs = skew.within_key_pairs(reps, ["sha256"], "inep", SIDE)
    return pairs.select(
        "sha256", *[F.col(f"a.{c}").alias(f"{c}_a") for c in SIDE], *[F.col(f"b.{c}").alias(f"{c}_b") for c in SIDE],
        F.lit(hashing.EXACT_LABEL).alias("tipo_duplicata"), F.lit(100.0).alias("similaridade"),
        F.lit(0).alias("distancia_hamming"),
    )


def exact_file_pairs(occ: DataFrame) -> DataFrame:
    """Pairs of occurrences of one image whose file or page differs."""
    side = ("occ_id", "pdf_filename", "pagina")
    pairs = skew.within_key_pairs(
        occ.select("sha256", *side), ["sha256"], "occ_id", side,
        condition=(F.col("a.pdf_filename") != F.col("b.pdf_filename")) | (F.col("a.pagina") != F.col("b.pagina")),
    )
    return pairs.select(
        "sha256", *[F.col(f"a.{c}").alias(f"{c}_a") for c in side], *[F.col(f"b.{c}").alias(f"{c}_b") for c in side]
    )


def visual_pairs(occ: DataFrame, edges: DataFrame, by: str = "inep", more: tuple[str, ...] = ()) -> DataFrame:
    """Similar but not identical images, expanded to occurrences whose school (or file) differs.

    ``edges`` holds distinct hash pairs. Images with the very same hash and another digest pair up inside their hash.
    ``more`` columns are kept of both sides.
    """
    side = ("occ_id", "inep", "pdf_filename", "pagina", "sha256", *more)
    rows = occ.where(groups.is_school()) if by == "inep" else occ
    rows = rows.select("phash", *side)
    row = F.struct(*side)
    differ = F.col(f"a.{by}") != F.col(f"b.{by}")
    across = skew.across_key_pairs(
        edges.select("phash_a", "phash_b", "distancia"), rows.select(F.col("phash").alias("phash_a"), row.alias("a")),
        rows.select(F.col("phash").alias("phash_b"), row.alias("b")), "phash_a", "phash_b",
    ).where(differ).select("distancia", "a", "b")
    mixed = (
        rows.groupBy("phash").agg(F.min("sha256").alias("lo"), F.max("sha256").alias("hi"))
        .where("lo < hi").select("phash")
    )
    inside = skew.within_key_pairs(
        rows.join(mixed, "phash", "left_semi"), ["phash"], "occ_id", side,
        condition=differ & (F.col("a.sha256") != F.col("b.sha256")),
    ).select(F.lit(0).alias("distancia"), F.struct(*[F.col(f"a.{c}") for c in side]).alias("a"),
             F.struct(*[F.col(f"b.{c}") for c in side]).alias("b"))
    both = across.select(F.col("distancia").cast("int"), "a", "b").unionByName(inside)
    first = F.col("a.occ_id") < F.col("b.occ_id")
    ordered = both.select(
        "distancia", F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"),
    )
    return ordered.select(
        *[F.col(f"a.{c}").alias(f"{c}_a") for c in side], *[F.col(f"b.{c}").alias(f"{c}_b") for c in side],
        F.lit(hashing.VISUAL_LABEL).alias("tipo_duplicata"),
        hashing.similarity(F.col("distancia")).alias("similaridade"), F.col("distancia").alias("distancia_hamming"),
    )


OCCURRENCE_KEY = ("inep", "pdf_url", "sha256")


def counterparts(member_rows: DataFrame) -> DataFrame:
    """(school, PDF, image) x other school of the same groups; the last group wins for a repeated school.

    Distinct keys meet the one-per-school representatives of their group, never each other.
    """
    reps = groups.representatives(
        member_rows, "grupo_seq", ["uf", "pagina", "pdf_filename", "pdf_url", "thumb_url"], schools_only=True
    ).select(
        F.col("grupo_seq").alias("__group"), F.col("inep").alias("outro_inep"),
        F.struct("uf", "pagina", "pdf_filename", "pdf_url", "thumb_url").alias("__other"),
    )
    keys = member_rows.select("grupo_seq", *OCCURRENCE_KEY).distinct()
    same = reps.select("__group", F.col("__group").alias("grupo_seq")).distinct()
    return (
        skew.across_key_pairs(same, keys, reps, "grupo_seq", "__group").where(~F.col("outro_inep").eqNullSafe(F.col("inep")))
        .groupBy(*OCCURRENCE_KEY, "outro_inep").agg(F.max_by("__other", "grupo_seq").alias("__other"))
        .select(*OCCURRENCE_KEY, "outro_inep", *[F.col(f"__other.{c}").alias(f"outro_{c}")
                for c in ("uf", "pagina", "pdf_filename", "pdf_url", "thumb_url")])
    )


def audited_rows(occ: DataFrame, member_rows: DataFrame) -> DataFrame:
    """Every occurrence with its duplicate flag and groups, matched by school + PDF + image (null school included)."""
    flags = member_rows.groupBy(*OCCURRENCE_KEY).agg(F.sort_array(F.collect_set("grupo_id")).alias("grupos"))
    match = None
    for c in OCCURRENCE_KEY:
        test = F.col(f"o.{c}").eqNullSafe(F.col(f"f.{c}")) if c == "inep" else F.col(f"o.{c}") == F.col(f"f.{c}")
        match = test if match is None else match & test
    return occ.alias("o").join(flags.alias("f"), match, "left").select(
        "o.*", F.col("f.grupos").isNotNull().alias("tem_duplicata"),
        F.coalesce("f.grupos", F.array().cast("array<string>")).alias("grupos"),
    )


def nest_counterparts(audited: DataFrame, other: DataFrame) -> DataFrame:
    """Report form: the counterparts of a row as one list, a single entry per school."""
    fields = [c for c in other.columns if c not in OCCURRENCE_KEY]
    lists = other.groupBy(*OCCURRENCE_KEY).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("duplicada_com"))
    match = (
        F.col("o.inep").eqNullSafe(F.col("f.inep")) & (F.col("o.pdf_url") == F.col("f.pdf_url"))
        & (F.col("o.sha256") == F.col("f.sha256"))
    )
    return audited.alias("o").join(lists.alias("f"), match, "left").select("o.*", "f.duplicada_com")


def flag_by_id_or_image(occ: DataFrame, pair_sides: DataFrame) -> DataFrame:
    """Looser flag of the supplier scan: the row's id or its digest is on either side of any pair."""
    ids = pair_sides.select("scan_id").where("scan_id is not null").distinct().withColumn("__by_id", F.lit(True))
    digests = pair_sides.select("sha256").distinct().withColumn("__by_sha", F.lit(True))
    return (
        occ.join(ids, "scan_id", "left").join(digests, "sha256", "left")
        .withColumn("tem_duplicata", F.coalesce("__by_id", "__by_sha", F.lit(False))).drop("__by_id", "__by_sha")
    )


def filter_pairs(pairs: DataFrame, search: str = "", kind: str = "", min_similarity: float = 0.0) -> DataFrame:
    """Result table filter: free text on either side, exact or visual, and a similarity floor."""
    out = pairs.where(F.col("similaridade") >= min_similarity)
    if kind == "exact":
        out = out.where(F.col("similaridade") == 100)
    elif kind == "visual":
        out = out.where(F.col("similaridade") < 100)
    term = search.lower()
    if term:
        def side(s: str):
            return F.lower(F.concat_ws(" ", *[
                F.coalesce(F.col(f"{c}_{s}").cast("string"), F.lit(""))
                for c in ("fornecedor", "inep", "uf", "pdf_filename")
            ]))
        out = out.where(side("a").contains(term) | side("b").contains(term))
    return out


def filter_pairs_by_supplier(pairs: DataFrame, supplier: str) -> DataFrame:
    term = supplier.strip().lower()
    hit = lambda s: F.coalesce(F.lower(F.col(f"fornecedor_{s}")).contains(term), F.lit(False))
    return pairs.where(hit("a") | hit("b"))


def with_defaults(pairs: DataFrame) -> DataFrame:
    """Fill what old pair rows lack: thumbnails, kind, similarity, distance and page."""
    digest = F.substring(F.coalesce("sha256", F.lit("")), 1, 16)

    def thumb(column: str, suffix: str):
        made = F.when(digest == "", F.lit("default.jpg")).otherwise(F.concat(digest, F.lit(suffix)))
        return F.coalesce(F.nullif(F.col(column), F.lit("")), made).alias(column)

    return pairs.withColumns({
        "thumb_url_a": thumb("thumb_url_a", "_1_0.jpg"), "thumb_url_b": thumb("thumb_url_b", "_1_1.jpg"),
        "tipo_duplicata": F.coalesce(F.nullif("tipo_duplicata", F.lit("")), F.lit(hashing.EXACT_LABEL)),
        "similaridade": F.coalesce(F.nullif("similaridade", F.lit(0.0)), F.lit(100.0)),
        "distancia_hamming": F.coalesce("distancia_hamming", F.lit(0)),
        "pagina_a": F.coalesce(F.nullif("pagina_a", F.lit(0)), F.lit(1)),
        "pagina_b": F.coalesce(F.nullif("pagina_b", F.lit(0)), F.lit(1)),
    })


def filter_audited(audited: DataFrame, supplier: str = "", duplicate: str = "", search: str = "") -> DataFrame:
    """Audited-row list: supplier text, duplicate flag, free text; flagged rows come first."""
    out = audited
    if supplier.strip():
        out = out.where(F.coalesce(F.lower("fornecedor").contains(supplier.strip().lower()), F.lit(False)))
    if duplicate.lower() in ("true", "1"):
        out = out.where("tem_duplicata")
    elif duplicate.lower() in ("false", "0"):
        out = out.where("not tem_duplicata")
    if search.strip():
        haystack = F.lower(F.concat_ws(
            " ", F.coalesce(F.nullif(F.col("inep"), F.lit(0)).cast("string"), F.lit("")),
            *[F.coalesce(c, F.lit("")) for c in ("uf", "fornecedor", "pdf_filename")],
        ))
        out = out.where(haystack.contains(search.strip().lower()))
    return out.orderBy(F.desc("tem_duplicata"), "inep")


def page_slice(df: DataFrame, order, page: int = 1, limit: int = 25, most: int = 200) -> DataFrame:
    """One page of a sorted list (limit clamped to 1..most)."""
    limit = min(most, max(1, limit))
    page = max(1, page)
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def with_total(page: DataFrame, whole: DataFrame) -> DataFrame:
    """Adds the exact number of rows the page was cut from. A count, not a window: the list is not sorted twice."""
    total = whole.agg(F.count(F.lit(1)).alias("total")).scalar()
    return page.withColumn("total", total)
