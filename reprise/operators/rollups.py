"""Counts over all duplicate pairs, worked out from multiplicities.

An image seen n times yields on the order of n squared pairs. The reports only need how many pairs touch a school, file or
supplier, and that follows from how often each occurs per image and per hash. So nothing here lists a pair, and a hot image
costs one row per school in it.

Where a function takes ``edges``, that is a radius, whose neighbours are added up in bounded cells without listing a pair of
hashes (:mod:`reprise.operators.neighbours`), or a list of pairs of hashes that is already there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprise.operators import groups, neighbours, skew
from reprise.session import materialise

# Fixed values ---------------------------------------------------------------------------------------------------------
NO_SUPPLIER = "Não informado"
NO_STATE = "-"
# ----------------------------------------------------------------------------------------------------------------------


def _sum(c: str, name: str) -> Column:
    return F.sum(c).alias(name)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("phash_a", "phash_b").unionByName(
        edges.select(F.col("phash_b").alias("phash_a"), F.col("phash_a").alias("phash_b")))


Edges = DataFrame | int


def near_sums(rows: DataFrame, part: list[str], edges: Edges) -> DataFrame:
    """(part, phash, near): ``n`` of the neighbouring hashes of the same part added up."""
    if isinstance(edges, int):
        return neighbours.sums(rows, part, edges)
    return (
        both_ways(edges).join(rows.withColumnRenamed("phash", "phash_b"), "phash_b")
        .groupBy(*part, F.col("phash_a").alias("phash")).agg(_sum("n", "near"))
    )


def near_rows(rows: DataFrame, edges: Edges) -> DataFrame:
    """(phash, near): rows on the neighbouring hashes, for the hashes that have any. Written, as several steps start from it."""
    return materialise(near_sums(rows.where("phash is not null").groupBy("phash").agg(F.count(F.lit(1)).alias("n")), [], edges), "near-rows")


def similar_hashes(rows: DataFrame, near: DataFrame) -> DataFrame:
    """Hashes with a neighbour or with several digests. No other row can be on a visual pair."""
    mixed = (
        rows.groupBy("phash").agg(F.min("sha256").alias("lo"), F.max("sha256").alias("hi")).where("lo < hi").select("phash")
    )
    return near.select("phash").unionByName(mixed).distinct()


def visual_partners(cells: DataFrame, edges: Edges, entity: str, within: str | None = None, near: DataFrame | None = None) -> DataFrame:
    """Per (image, entity): occurrences ``n`` and visual partners of each (similar image, other entity).

    Partners have another digest and either the same hash or a neighbouring one. With ``within`` both sides must also agree
    on that column. ``cells`` carries occurrence counts in ``n``. ``near`` is (within, phash, near), the occurrences on the
    neighbours of a hash, if that is known already.
    """
    g = [within] if within else []
    image = cells.groupBy(*g, "sha256", "phash", entity).agg(_sum("n", "n"))
    by_hash = image.groupBy(*g, "phash", entity).agg(_sum("n", "n_hash"))
    if isinstance(edges, int):
        by_hash = materialise(by_hash, "held-by-hash")
    image_all = image.groupBy(*g, "sha256").agg(_sum("n", "all_image"))
    hash_all = by_hash.groupBy(*g, "phash").agg(_sum("n_hash", "all_hash"))
    if near is None:
        near = near_sums(hash_all.withColumnRenamed("all_hash", "n"), g, edges)
    near_all = near.select(*g, "phash", F.col("near").alias("all_near"))
    near_own = near_sums(by_hash.withColumnRenamed("n_hash", "n"), [*g, entity], edges).withColumnRenamed("near", "n_near")
    zero = lambda c: F.coalesce(c, F.lit(0))
    # Files of digests and counts are small for their rows, so none of these sides may be broadcast by its size.
    found = skew.shuffled(image, by_hash, [*g, "phash", entity])
    found = skew.shuffled(skew.shuffled(found, image_all, [*g, "sha256"]), hash_all, [*g, "phash"])
    found = skew.shuffled(skew.shuffled(found, near_all, [*g, "phash"], "left"), near_own, [*g, "phash", entity], "left")
    return found.select(*g, "sha256", "phash", entity, "n", (
        (F.col("all_hash") - F.col("n_hash")) - (F.col("all_image") - F.col("n"))
        + zero("all_near") - zero("n_near")
    ).alias("parceiros"))


def _school_rows(occ: DataFrame) -> DataFrame:
    return occ.where(groups.is_school()).withColumns({
        "fornecedor": F.coalesce(F.nullif("fornecedor", F.lit("")), F.lit(NO_SUPPLIER)),
        "uf": F.coalesce(F.nullif("uf", F.lit("")), F.lit(NO_STATE)),
    })


def _exact_reps(rows: DataFrame) -> DataFrame:
    """One row per (image, school) with the number of schools of the image, for images in two schools or more."""
    reps = materialise(groups.shared_representatives(rows, ["fornecedor", "uf"]), "exact-sides")
    return skew.shuffled(reps, reps.groupBy("sha256").agg(F.count(F.lit(1)).alias("k")), ["sha256"])


def _similar_cells(rows: DataFrame, edges: Edges, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(sha256, phash, columns, n) of the hashes that may be on a visual pair, and (phash, near) of all rows."""
    near = near_rows(rows, edges)
    # Rows are combined before they meet a hash that may be hot, as in skew.reduce_wanted.
    counted = rows.groupBy("sha256", "phash", *columns).agg(F.count(F.lit(1)).alias("n"))
    return materialise(skew.shuffled(counted, similar_hashes(rows, near), ["phash"]), "similar-cells"), near


def affected_schools(occ: DataFrame, edges: Edges) -> DataFrame:
    """Per school: number of pair sides it appears on and of distinct PDFs involved."""
    rows = _school_rows(occ)
    exact = _exact_reps(rows).select(
        "inep", "fornecedor", "uf", "pdf_filename", (F.col("k") - 1).alias("lados"))
    cells, near = _similar_cells(rows, edges, "inep", "fornecedor", "uf", "pdf_filename")
    partners = visual_partners(cells, edges, "inep", near=near).where("parceiros > 0").select("sha256", "inep", "parceiros")
    visual = skew.shuffled(cells, partners, ["sha256", "inep"]).select(
        "inep", "fornecedor", "uf", "pdf_filename", (F.col("n") * F.col("parceiros")).alias("lados"))
    per_file = exact.unionByName(visual).groupBy("inep", "pdf_filename").agg(
        _sum("lados", "lados"), F.min(F.struct("fornecedor", "uf")).alias("who"))
    return per_file.groupBy("inep").agg(
        _sum("lados", "duplicate_count"), F.count("pdf_filename").alias("pdfs_count"), F.min("who").alias("who"),
    ).select("inep", "who.uf", "who.fornecedor", "duplicate_count", "pdfs_count")


def supplier_rollup(occ: DataFrame, edges: Edges) -> DataFrame:
    """Per supplier field: pairs with that supplier on at least one side, split in exact and visual, and schools touched."""
    rows = _school_rows(occ)
    reps = _exact_reps(rows)
    own = reps.groupBy("sha256", "fornecedor").agg(
        F.count(F.lit(1)).alias("k_own"), F.first("k").alias("k"), F.min("inep").alias("lo"), F.max("inep").alias("hi"))
    two = lambda c: c * (c - 1) / 2
    exact = own.select("fornecedor", (two(F.col("k")) - two(F.col("k") - F.col("k_own"))).cast("bigint").alias("exact_pairs"),
                       F.lit(0).cast("bigint").alias("visual_pairs"))
    held, near = _similar_cells(rows, edges, "inep", "fornecedor")
    partners = visual_partners(held, edges, "inep", near=near).select("sha256", "inep", "parceiros")
    touching = materialise(skew.shuffled(held, partners, ["sha256", "inep"]), "touching")
    met = _suppliers_met(held, edges)
    both_sides = visual_partners(held, edges, "inep", within="fornecedor", near=met)
    # A pair with the supplier on both sides was counted from either side; take it back once.
    visual = touching.select("fornecedor", (F.col("n") * F.col("parceiros")).cast("double").alias("v")).unionByName(
        both_sides.select("fornecedor", (-F.col("n") * F.col("parceiros") / 2).alias("v")))
    visual = visual.groupBy("fornecedor").agg(F.sum("v").cast("bigint").alias("visual_pairs")).where("visual_pairs > 0")
    counts = exact.unionByName(visual.select("fornecedor", F.lit(0).cast("bigint").alias("exact_pairs"), "visual_pairs"))
    totals = counts.groupBy("fornecedor").agg(_sum("exact_pairs", "exact_pairs"), _sum("visual_pairs", "visual_pairs"))

    # Schools on either side: the supplier's own schools that have a partner, and the partners of its schools.
    own_side = reps.select("fornecedor", "inep").unionByName(
        touching.where("parceiros > 0").select("fornecedor", "inep"))
    exact_other = skew.shuffled(reps.select("sha256", "inep"), own.select("sha256", "fornecedor", "lo", "hi"), ["sha256"]).where(
        "not (lo = inep and hi = inep)").select("fornecedor", "inep")
    visual_other = _visual_counterparts(held, met)
    schools = own_side.unionByName(exact_other).unionByName(visual_other).distinct().groupBy("fornecedor").agg(
        F.count(F.lit(1)).alias("affected_ineps_count"))
    return totals.join(schools, "fornecedor").select(
        "fornecedor", (F.col("exact_pairs") + F.col("visual_pairs")).alias("total_pairs"), "exact_pairs", "visual_pairs",
        "affected_ineps_count")


def _suppliers_met(held: DataFrame, edges: Edges) -> DataFrame:
    """(phash, fornecedor, lo, hi, near): suppliers on the neighbours of a hash, the range of their schools and their occurrences there."""
    per_hash = held.groupBy("phash", "fornecedor").agg(F.min("inep").alias("lo"), F.max("inep").alias("hi"), _sum("n", "n"))
    if isinstance(edges, int):
        return materialise(neighbours.reach(per_hash, "fornecedor", edges), "suppliers-met")
    return both_ways(edges).join(per_hash.withColumnRenamed("phash", "phash_b"), "phash_b").groupBy(
        F.col("phash_a").alias("phash"), "fornecedor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), _sum("n", "near"))


def _visual_counterparts(held: DataFrame, met: DataFrame) -> DataFrame:
    """(fornecedor, inep): the school holds an image similar to one the supplier filed for another school."""
    schools = held.select("phash", "inep").distinct()
    across = skew.shuffled(met, schools, ["phash"]).where("not (lo = inep and hi = inep)").select("fornecedor", "inep")
    # Same hash, other digest: count the supplier's rows there and take away those of the school or of its own digests.
    several = held.groupBy("phash").agg(F.min("sha256").alias("a"), F.max("sha256").alias("b")).where("a < b").select("phash")
    mixed = skew.shuffled(held, several, ["phash"], "left_semi")
    f_hash = mixed.groupBy("phash", "fornecedor").agg(_sum("n", "f_hash"))
    f_school = mixed.groupBy("phash", "fornecedor", "inep").agg(_sum("n", "f_school"))
    f_image = mixed.groupBy("phash", "sha256", "fornecedor").agg(_sum("n", "f_image"))
    f_cell = mixed.groupBy("phash", "sha256", "fornecedor", "inep").agg(_sum("n", "f_cell"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    inside = skew.shuffled(mixed.select("phash", "sha256", "inep").distinct(), f_hash, ["phash"])
    for counts, keys in ((f_school, ["phash", "fornecedor", "inep"]), (f_image, ["phash", "sha256", "fornecedor"]),
                         (f_cell, ["phash", "sha256", "fornecedor", "inep"])):
        inside = skew.shuffled(inside, counts, keys, "left")
    inside = inside.where(F.col("f_hash") - zero("f_school") - zero("f_image") + zero("f_cell") > 0).select("fornecedor", "inep")
    return across.unionByName(inside)


def _file_sides(occ: DataFrame, edges: Edges) -> DataFrame:
    """(file, page, exact sides, visual sides) per image."""
    repeated = occ.groupBy("sha256").agg(F.count(F.lit(1)).alias("total")).where("total > 1")

    def count(part: DataFrame) -> DataFrame:
        return part.groupBy("sha256", "pdf_filename", "pagina").agg(F.count(F.lit(1)).alias("n"))

    held = materialise(skew.reduce_wanted(occ, repeated, "sha256", count), "repeated-cells")
    exact = skew.shuffled(held, held.groupBy("sha256").agg(_sum("n", "total")), ["sha256"]).select("pdf_filename", "pagina", (F.col("n") * (F.col("total") - F.col("n"))).alias("exatos"),
             F.lit(0).cast("bigint").alias("visuais"))
    cells, near = _similar_cells(occ, edges, "pdf_filename", "pagina")
    partners = visual_partners(cells, edges, "pdf_filename", near=near).where("parceiros > 0").select(
        "sha256", "pdf_filename", "parceiros")
    visual = skew.shuffled(cells, partners, ["sha256", "pdf_filename"]).select(
        "pdf_filename", "pagina", F.lit(0).cast("bigint").alias("exatos"),
        (F.col("n") * F.col("parceiros")).alias("visuais"))
    per_page = exact.unionByName(visual).where("exatos + visuais > 0").groupBy("pdf_filename", "pagina").agg(
        _sum("exatos", "exatos"), _sum("visuais", "visuais"))
    return materialise(per_page, "file-sides")


def affected_files(occ: DataFrame, edges: Edges) -> DataFrame:
    """Per file: pair sides and the sorted pages involved (a list no longer than the file has pages)."""
    pages = _file_sides(occ, edges).withColumn("lados", F.col("exatos") + F.col("visuais"))
    return pages.groupBy("pdf_filename").agg(
        _sum("lados", "duplicate_count"), F.sort_array(F.collect_list("pagina")).alias("impacted_pages"))


def scan_totals(occ: DataFrame, edges: Edges) -> DataFrame:
    """One row: images, digests, files, pairs by kind and affected files."""
    sides = _file_sides(occ, edges)
    parts = [
        occ.agg(F.count(F.lit(1)).alias("total_images")),
        occ.select("sha256").distinct().agg(F.count(F.lit(1)).alias("unique_hashes")),
        occ.select("pdf_filename").distinct().agg(F.count(F.lit(1)).alias("total_pdfs_analyzed")),
        sides.agg(
            (F.coalesce(F.sum("exatos"), F.lit(0)) / 2).cast("bigint").alias("exact_duplicate_pairs"),
            (F.coalesce(F.sum("visuais"), F.lit(0)) / 2).cast("bigint").alias("visual_duplicate_pairs")),
        sides.select("pdf_filename").distinct().agg(F.count(F.lit(1)).alias("affected_files_count")),
    ]
    out = parts[0].withColumn("__row", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("__row", F.lit(1)), "__row")
    return out.drop("__row").withColumn(
        "total_duplicate_pairs", F.col("exact_duplicate_pairs") + F.col("visual_duplicate_pairs"))


def _scan_cells(schools: DataFrame, occ: DataFrame, *more: str) -> DataFrame:
    """(nome, sha256, inep, ..., n): what each supplier's scan sees. Occurrences are counted before they meet a name."""
    once = occ.where("fornecedor <> ''").groupBy("fornecedor", "sha256", "inep", *more).agg(F.count(F.lit(1)).alias("n"))
    fields = occ.where("fornecedor <> ''").select("fornecedor").distinct()
    met = once.join(name_matches(fields, supplier_list(schools)), "fornecedor")
    return met.groupBy("nome", "sha256", "inep", *more).agg(_sum("n", "n"))


def _scan_reps(schools: DataFrame, occ: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    cells = materialise(_scan_cells(schools, occ), "scan-cells")
    reps = cells.where(groups.is_school()).select("nome", "sha256", "inep")
    return cells, reps, reps.groupBy("nome", "sha256").agg(F.count(F.lit(1)).alias("k")).where("k > 1")


def _scan_visual(schools: DataFrame, hashed: DataFrame, edges: Edges) -> DataFrame:
    """(nome, inep, lados): visual pair sides of a school in one supplier's scan. Counts meet, per (supplier, digest, school)."""
    rows = hashed.where(groups.is_school())
    similar = similar_hashes(rows, near_rows(rows, edges))
    cells = materialise(skew.shuffled(_scan_cells(schools, rows, "phash"), similar, ["phash"]), "scan-visual-cells")
    partners = visual_partners(cells, edges, "inep", within="nome")
    return partners.where("parceiros > 0").groupBy("nome", "inep").agg(
        F.sum(F.col("n") * F.col("parceiros")).alias("lados"))


def all_supplier_totals(schools: DataFrame, occ: DataFrame) -> DataFrame:
    """Totals of running the exact scan once per supplier name of the register, as one job; a name that no image has counts 0.

    A school is scanned under every name whose text its supplier field contains; pairs only form inside one such scan.
    """
    scans, reps, sizes = _scan_reps(schools, occ)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        supplier_list(schools).join(_totals(scans, sizes), "nome", "left").join(_per_name(_exact_touched(reps, sizes)), "nome", "left")
        .select("nome", zero("imagens"), zero("pares"), zero("escolas_afetadas"))
    )


def all_supplier_totals_visual(schools: DataFrame, occ: DataFrame, hashed: DataFrame, edges: Edges) -> DataFrame:
    """As ``all_supplier_totals``, with exact and visual pairs. ``hashed`` holds the occurrences that have a hash."""
    scans, reps, sizes = _scan_reps(schools, occ)
    sides = materialise(_scan_visual(schools, hashed, edges), "scan-visual")
    visual = sides.groupBy("nome").agg(F.expr("sum(lados) div 2").alias("visuais"))
    touched = _per_name(_exact_touched(reps, sizes).unionByName(sides.select("nome", "inep")).distinct())
    zero = lambda c: F.coalesce(c, F.lit(0))
    names = supplier_list(schools).join(_totals(scans, sizes), "nome", "left")
    return names.join(visual, "nome", "left").join(touched, "nome", "left").select(
        "nome", zero("imagens").alias("imagens"), zero("pares").alias("exact_pairs"), zero("visuais").alias("visual_pairs"),
        (zero("pares") + zero("visuais")).alias("pares"), zero("escolas_afetadas").alias("escolas_afetadas"))


def _totals(scans: DataFrame, sizes: DataFrame) -> DataFrame:
    pairs = sizes.groupBy("nome").agg(F.sum(F.expr("k * (k - 1) div 2")).alias("pares"))
    return scans.groupBy("nome").agg(_sum("n", "imagens")).join(pairs, "nome", "left")


def _exact_touched(reps: DataFrame, sizes: DataFrame) -> DataFrame:
    return skew.shuffled(reps, sizes, ["nome", "sha256"], "left_semi").select("nome", "inep").distinct()


def _per_name(touched: DataFrame) -> DataFrame:
    return touched.groupBy("nome").agg(F.count(F.lit(1)).alias("escolas_afetadas"))


def accumulated_schools(schools: DataFrame, occ: DataFrame) -> DataFrame:
    """Affected schools over all supplier scans, by exact pairs; of a school found by several the first name's row counts."""
    return _first_name(_exact_sides(schools, occ))


def accumulated_schools_visual(schools: DataFrame, occ: DataFrame, hashed: DataFrame, edges: Edges) -> DataFrame:
    """As ``accumulated_schools``, with exact and visual pairs."""
    return _first_name(_exact_sides(schools, occ).unionByName(_scan_visual(schools, hashed, edges)))


def _exact_sides(schools: DataFrame, occ: DataFrame) -> DataFrame:
    _, reps, sizes = _scan_reps(schools, occ)
    return skew.shuffled(reps, sizes, ["nome", "sha256"]).groupBy("nome", "inep").agg(F.sum(F.col("k") - 1).alias("lados"))


def _first_name(sides: DataFrame) -> DataFrame:
    rows = sides.groupBy("inep", "nome").agg(F.sum("lados").alias("duplicate_count"))
    return rows.groupBy("inep").agg(
        F.min("nome").alias("fornecedor"), F.min_by("duplicate_count", "nome").alias("duplicate_count"))


def supplier_list(schools: DataFrame) -> DataFrame:
    """Distinct supplier names after splitting tagged fields."""
    from reprise.functions.text import supplier_names

    return schools.select("fornecedor").distinct().select(F.explode(supplier_names("fornecedor")).alias("nome")).distinct()


#: Names up to this many bytes are sent to every task as one automaton.
NAME_BYTES = 8 << 20


def name_matches(fields: DataFrame, names: DataFrame, most: int = NAME_BYTES) -> DataFrame:
    """(fornecedor, nome): the names that each distinct supplier field contains, case-insensitively.

    All names are looked for in one pass over a field by an automaton of the names, as long as these take no more than ``most``
    bytes. Beyond that fields are spelled out into their substrings and meet the names in an equi-join.
    """
    spelled = names.where("nome <> ''").select("nome", F.lower("nome").alias("__lower")).distinct()
    size = spelled.agg(F.sum(F.octet_length("nome") + F.octet_length("__lower"))).first()[0] or 0
    if size > most:
        return _matches_by_pieces(fields, spelled)
    by_word: dict[str, list[str]] = {}
    for r in spelled.collect():  # at most ``most`` bytes
        by_word.setdefault(r["__lower"], []).append(r["nome"])
    shared = fields.sparkSession.sparkContext.broadcast(by_word)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, own in shared.value.items():
            automaton.add_word(word, own)
        if shared.value:
            automaton.make_automaton()
        for pdf in batches:
            rows = []
            for field, lower in zip(pdf["fornecedor"], pdf["__lower"]):
                found = {n for _, own in automaton.iter(lower) for n in own} if shared.value else ()
                rows += [(field, n) for n in sorted(found)]
            yield pd.DataFrame(rows, columns=["fornecedor", "nome"], dtype=object)

    lowered = fields.where("fornecedor <> ''").select("fornecedor", F.lower("fornecedor").alias("__lower"))
    return lowered.mapInPandas(run, "fornecedor string, nome string")


def _matches_by_pieces(fields: DataFrame, spelled: DataFrame) -> DataFrame:
    lower, size = F.lower("fornecedor"), F.length("fornecedor")
    pieces = F.flatten(F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substring(lower, i, n))))
    return (
        fields.where("fornecedor <> ''").select("fornecedor", F.explode(F.array_distinct(pieces)).alias("__lower"))
        .join(spelled, "__lower").select("fornecedor", "nome")
    )


def supplier_scans(occ: DataFrame, names: DataFrame) -> DataFrame:
    """Occurrences tagged with each supplier name their field contains."""
    return occ.join(name_matches(occ.select("fornecedor").distinct(), names), "fornecedor")


def school_sides(occ: DataFrame, hashed: DataFrame, edges: Edges) -> DataFrame:
    """(inep, uf, fornecedor, count): pair sides of every school on an exact or visual pair, without listing a pair."""
    exact = _exact_reps(occ.where(groups.is_school())).select("inep", "uf", "fornecedor", (F.col("k") - 1).alias("lados"))
    cells, near = _similar_cells(hashed.where(groups.is_school()), edges, "inep", "uf", "fornecedor")
    partners = visual_partners(cells, edges, "inep", near=near).where("parceiros > 0").select("sha256", "inep", "parceiros")
    visual = skew.shuffled(cells, partners, ["sha256", "inep"]).select("inep", "uf", "fornecedor", (F.col("n") * F.col("parceiros")).alias("lados"))
    return exact.unionByName(visual).groupBy("inep").agg(
        F.min("uf").alias("uf"), F.min("fornecedor").alias("fornecedor"), _sum("lados", "count"))


def school_pair_totals(occ: DataFrame, hashed: DataFrame, edges: Edges) -> DataFrame:
    """One row: exact and visual pairs of schools."""
    sizes = groups.shared_representatives(occ.where(groups.is_school()), []).groupBy("sha256").agg(F.count(F.lit(1)).alias("k"))
    cells, near = _similar_cells(hashed.where(groups.is_school()), edges, "inep")
    visual = visual_partners(cells, edges, "inep", near=near).agg(F.expr("coalesce(sum(n * parceiros) div 2, 0)").alias("visuais"))
    exact = sizes.agg(F.expr("coalesce(sum(k * (k - 1) div 2), 0)").alias("exatos"))
    row = F.lit(1).alias("__row")
    return exact.select("*", row).join(visual.select("*", row), "__row").drop("__row")
