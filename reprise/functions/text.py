"""Names, addresses, dates and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------------------------------------------------
WHITESPACE = " \t\n\r\x0b\x0c"
INTERNAL_TAG = " (RI)"
EXTERNAL_TAG = " (RE)"
UNKNOWN_SUPPLIER = "Nao informado"
DEFAULT_STATUS = "Conectada"
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇ"
UNACCENTED = "aaaaaeeeeiiiiooooouuuucAAAAAEEEEIIIIOOOOOUUUUC"
MEMBER_NAME_LENGTH = 70
RUN_SLUG_LENGTH = 24
DATE_FORMATS = (
    "yyyy-M-d'T'H:mm[:ss][.SSSSSSSSS][XXX][XX][X]",
    "yyyy-M-d H:mm[:ss][.SSSSSSSSS][ ][XXX][XX][X]",
    "yyyy-M-d",
    "yyyy/M/d[ H:mm][:ss]",
    "M/d/yyyy[ H:mm][:ss]",
    "M/d/yyyy h:mm[:ss] a",
    "d/M/yyyy[ H:mm][:ss]",
    "d/M/yyyy h:mm[:ss] a",
    "MMM d, yyyy[ H:mm][:ss]",
    "MMM d, yyyy h:mm[:ss] a",
    "MMMM d, yyyy[ H:mm][:ss]",
    "MMMM d, yyyy h:mm[:ss] a",
    "d MMM yyyy[ H:mm][:ss]",
    "d MMMM yyyy[ H:mm][:ss]",
    "d-MMM-yyyy",
    "yyyyMMdd",
)
MIME_TYPES = {
    "pdf": "application/pdf",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "zip": "application/zip",
}
DEFAULT_MIME = "application/octet-stream"
# ----------------------------------------------------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of blank; ``trim`` alone only drops spaces."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def empty_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def supplier_names(c: Column | str) -> Column:
    """Individual names held in a supplier field; "/" only separates when a network tag is present."""
    c = _col(c)

    def untag(part: Column) -> Column:
        return strip(F.replace(F.replace(strip(part), F.lit(INTERNAL_TAG), F.lit("")), F.lit(EXTERNAL_TAG), F.lit("")))

    tagged = c.contains(INTERNAL_TAG) | c.contains(EXTERNAL_TAG)
    names = F.when(tagged, F.transform(F.split(c, "/"), untag)).otherwise(F.array(strip(c)))
    return F.filter(names, lambda n: n.isNotNull() & (n != ""))


def parse_pdf_name(c: Column | str) -> Column:
    """``INEP - UF - CITY - SCHOOL - KIND.pdf`` as a struct; a name off the pattern gives empty fields."""
    c = _col(c)
    stem = F.when(F.lower(c).endswith(".pdf"), F.substring(c, F.lit(1), F.length(c) - 4)).otherwise(c)
    blank = F.struct(
        F.lit(None).cast("bigint").alias("inep"), *[F.lit("").alias(c) for c in ("uf", "municipio", "escola")])

    def fields(parts: Column) -> Column:
        n = F.size(parts)
        school = F.when(n > 4, F.array_join(F.slice(parts, F.lit(4), n - 4), " - ")).otherwise(parts[3])
        return F.when(
            (n >= 4) & F.get(parts, F.lit(0)).rlike("^[0-9]+$") & F.get(parts, F.lit(1)).rlike("^[A-Z]{2}$"),
            F.struct(parts[0].try_cast("bigint").alias("inep"), parts[1].alias("uf"), parts[2].alias("municipio"),
                     school.alias("escola")),
        ).otherwise(blank)

    # The one-element transform binds the split name, so it is not split again for every field.
    bound = F.transform(F.array(F.transform(F.split(stem, " - "), strip)), fields)
    return F.coalesce(F.get(bound, F.lit(0)), blank)


def inep_mismatch(name_inep: Column, record_inep: Column) -> Column:
    """The file is named after another school than the one it is filed under."""
    return F.coalesce((name_inep != 0) & ~name_inep.eqNullSafe(record_inep), F.lit(False))


def url_file_name(c: Column | str) -> Column:
    """Last path segment without the query, percent-decoded; "+" stays a plus sign."""
    segment = F.substring_index(F.substring_index(_col(c), "/", -1), "?", 1)
    return F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)


def absolute_url(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c.startswith("//"), F.concat(F.lit("https:"), c)).otherwise(c)


def parse_books(c: Column | str) -> Column:
    """Comma-separated addresses; null gives an empty list."""
    items = F.filter(F.transform(F.split(_col(c), ","), lambda u: absolute_url(strip(u))), lambda u: u != "")
    return F.coalesce(items, F.array().cast("array<string>"))


def books_array(c: Column | str) -> Column:
    """``books`` stored as text: a JSON list, or else one bare address."""
    c = _col(c)
    parsed = F.from_json(c, "array<string>")
    listed = F.when(strip(c).startswith("[") & parsed.isNotNull(), parsed).otherwise(F.array(c))
    return F.filter(listed, lambda u: u.isNotNull() & (u != ""))


def parse_date(c: Column | str) -> Column:
    """First format that fits; anything unreadable becomes null."""
    text = F.nullif(strip(c), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(text, "(?i) am$", " AM"), "(?i) pm$", " PM")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(fmt)) for fmt in DATE_FORMATS])


def supplier_composition(internal: Column | str, external: Column | str) -> Column:
    """(kind, display name) from the internal- and external-network supplier columns."""
    ri, re_ = empty_to_null(internal), empty_to_null(external)
    both = ri.isNotNull() & re_.isNotNull()
    kind = F.when(both, "RI / RE").when(ri.isNotNull(), "RI").when(re_.isNotNull(), "RE")
    name = F.when(both, F.concat(ri, F.lit(INTERNAL_TAG + " / "), re_, F.lit(EXTERNAL_TAG))).otherwise(F.coalesce(ri, re_))
    return F.struct(kind.alias("tipo"), name.alias("nome"))


def normalise_phase(c: Column | str) -> Column:
    return F.regexp_replace(strip(c), r"\.0$", "")


def status_or_default(c: Column | str) -> Column:
    return F.coalesce(empty_to_null(c), F.lit(DEFAULT_STATUS))


def register_key(current: Column, inep: Column, prefix: str = "inep_") -> Column:
    """Key a school already has, else one built from its own id (never from a row position)."""
    return F.coalesce(current, F.concat(F.lit(prefix), inep.cast("string")))


def safe_file_name(c: Column | str) -> Column:
    folded = F.translate(_col(c), ACCENTED, UNACCENTED)
    return F.btrim(F.regexp_replace(folded, "[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def safe_member_name(c: Column | str) -> Column:
    return F.substring(F.regexp_replace(_col(c), r"[^\p{L}\p{N} \-_.]", "_"), 1, MEMBER_NAME_LENGTH)


def file_extension(c: Column | str) -> Column:
    """Lower-case extension without the dot; a leading dot alone is not an extension."""
    return F.lower(F.regexp_extract(_col(c), r"^.*[^./\\][^/\\]*?\.([^./\\]*)$", 1))


def mime_type(c: Column | str) -> Column:
    ext = file_extension(c)
    out = F.lit(DEFAULT_MIME)
    for key, value in MIME_TYPES.items():
        out = F.when(ext == key, value).otherwise(out)
    return out


def pair_id(a: Column, b: Column) -> Column:
    return F.concat(a.cast("string"), F.lit("x"), b.cast("string"))


def run_id(phase: Column, supplier: Column, started: Column) -> Column:
    slug = F.lower(F.btrim(F.substring(F.regexp_replace(supplier, r"[^\p{L}\p{N}]", "_"), 1, RUN_SLUG_LENGTH), F.lit("_")))
    target = F.when(F.coalesce(supplier, F.lit("")) == "", "todos").otherwise(slug)
    return F.concat(
        F.lit("fase"), F.replace(phase, F.lit("."), F.lit("_")), F.lit("_"), target,
        F.lit("_"), F.date_format(started, "yyyyMMdd_HHmmss"),
    )


def document_id(lot: Column, inep: Column, created: Column) -> Column:
    return F.concat_ws("_", lot, inep.cast("string"), F.date_format(created, "yyyyMMdd_HHmmss"))


def thumb_name(sha: Column, page: Column, xref: Column) -> Column:
    return F.concat(
        F.substring(sha, 1, 16), F.lit("_"), page.cast("string"), F.lit("_"), xref.cast("string"), F.lit(".jpg")
    )
