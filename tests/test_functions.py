import pytest
from pyspark.sql import functions as F

from reprise.functions import geo, hashing, images, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("d,expected", [
    (0, 100.0), (1, 98.4), (2, 96.9), (4, 93.8), (8, 87.5), (12, 81.2), (20, 68.8), (28, 56.2), (64, 0.0)])
def test_similarity_rounds_half_even(spark, d, expected):
    assert one(spark, hashing.similarity(F.lit(d))) == expected


def test_hex_and_hamming(spark):
    assert one(spark, hashing.hex_to_long(F.lit("ffffffffffffffff"))) == -1
    assert one(spark, hashing.hex_to_long(F.lit("8000000000000000"))) == -9223372036854775808
    far = hashing.hamming(hashing.hex_to_long(F.lit("ffffffffffffffff")), hashing.hex_to_long(F.lit("000000000000000f")))
    assert one(spark, far) == 60


@pytest.mark.parametrize("a,b,metres,kind", [
    ((-23.7015, -46.6333), (-23.7020, -46.6330), 63.4, "fora"), ((-10.0, -48.0), (-10.0004, -48.0), 44.5, "dentro"),
    ((-10.0, -48.0), (-10.05, -48.0), 5559.7, "suspeita")])
def test_distance_and_situation(spark, a, b, metres, kind):
    d = geo.haversine_m(*[F.lit(x) for x in (*a, *b)])
    assert one(spark, F.round(d, 1)) == metres
    assert one(spark, geo.situation(d)) == kind


def test_digit_repair(spark):
    far = one(spark, geo.repair_digit(F.lit(-3.7015), F.lit(-46.6333), F.lit(-23.7015), F.lit(-46.6333)))
    assert (round(far["lat"], 4), far["lon"], far["reparado"]) == (-23.7015, -46.6333, True)
    near = one(spark, geo.repair_digit(F.lit(-23.7016), F.lit(-46.6333), F.lit(-23.7015), F.lit(-46.6333)))
    assert near["lat"] == -23.7016 and not near["reparado"]
    lost = one(spark, geo.repair_digit(F.lit(-1.0), F.lit(-40.0), F.lit(-23.7), F.lit(-46.6)))
    assert lost["lat"] == -1.0 and not lost["reparado"]


@pytest.mark.parametrize("stamp,expected", [
    ("-3.7015° S 、 -46.6333 W", (-3.7015, -46.6333)), ("3,7015 S, 46,6333 O", (-3.7015, -46.6333)),
    ("51.500100 N, 10.120000 E | -23.701500, -46.633300", (-23.7015, -46.6333)), ("sem carimbo", None),
    ("-3.70, -46.63", None)])
def test_coordinate_text(spark, stamp, expected):
    found = one(spark, geo.extract_coordinate(F.lit(stamp)))
    assert (tuple(found) if found else None) == expected


@pytest.mark.parametrize("field,expected", [
    ("X (RI) / Y (RE)", ["X", "Y"]), ("A / B", ["A / B"]), (None, None), ("  A  ", ["A"]), ("X (RI) / ", ["X"]), ("", [])])
def test_supplier_names(spark, field, expected):
    got = one(spark, text.supplier_names(F.lit(field).cast("string")))
    assert (got or []) == (expected or [])


@pytest.mark.parametrize("name,expected", [
    ("12009679 - AC - BUJARI - ESC A - B - TIPP.pdf", (12009679, "AC", "BUJARI", "ESC A - B")),
    ("Modelo - Aviso.pdf", (None, "", "", "")), ("1 - AC - X - Y", (1, "AC", "X", "Y")), (None, (None, "", "", "")),
    ("x1 - AC - X - Y.pdf", (None, "", "", "")), ("12 - ac - X - Y.pdf", (None, "", "", ""))])
def test_pdf_name(spark, name, expected):
    assert tuple(one(spark, text.parse_pdf_name(F.lit(name).cast("string")))) == expected


@pytest.mark.parametrize("w,h,expected", [
    (1600, 1200, True), (1200, 1600, True), (2048, 1153, False), (1240, 1754, False), (0, 10, False), (None, 5, False)])
def test_camera_aspect(spark, w, h, expected):
    assert one(spark, images.camera_aspect(F.lit(w).cast("int"), F.lit(h).cast("int"))) is expected


def test_url_names_and_dates(spark):
    assert one(spark, text.url_file_name(F.lit("https://h/x/a%20b+c.pdf?sig=1"))) == "a b+c.pdf"
    assert one(spark, text.url_file_name(F.lit("https://h/100%.pdf"))) == "100%.pdf"
    assert one(spark, text.parse_books(F.lit(" //h/a.pdf, ,https://h/b.pdf"))) == ["https://h/a.pdf", "https://h/b.pdf"]
    assert str(one(spark, text.parse_date(F.lit("08/25/2026 13:05")))) == "2026-08-25 13:05:00"
    assert str(one(spark, text.parse_date(F.lit("25/08/2026")))) == "2026-08-25 00:00:00"
    assert str(one(spark, text.parse_date(F.lit("Aug 5, 2026 3:20 pm")))) == "2026-08-05 15:20:00"
    assert one(spark, text.parse_date(F.lit("amanhã"))) is None
    assert [one(spark, text.normalise_phase(F.lit(x))) for x in ("3.0", "10", "4.1", "Piloto")] == ["3", "10", "4.1", "Piloto"]


def test_safe_names(spark):
    assert one(spark, text.safe_file_name(F.lit("Relatório (ção) 1.pdf"))) == "Relatorio_cao_1.pdf"
    assert one(spark, text.safe_member_name(F.lit("a/b:ç - x.pdf"))) == "a_b_ç - x.pdf"
    assert len(one(spark, text.safe_member_name(F.lit("x" * 90)))) == 70
    assert one(spark, text.mime_type(F.lit("a.b.XLSX"))).endswith("spreadsheetml.sheet")
    assert one(spark, text.mime_type(F.lit("a"))) == "application/octet-stream"


def classify(spark, w, h, uni=0.0, flat=0.1, grad=9.0, white=0.1, sat=40.0, cores=90, stamp=False):
    return one(spark, images.classify(*[F.lit(x) for x in (w, h)], F.lit(uni).cast("double"), *[
        F.lit(x) for x in (flat, grad, white, sat, cores, stamp)]))


def test_classes(spark):
    assert classify(spark, 399, 300, stamp=True) == "logo"
    assert classify(spark, 800, 600, uni=0.5, stamp=True) == "foto"
    assert classify(spark, 800, 600, uni=None) == "indefinido"
    assert classify(spark, 800, 600, uni=None, stamp=True) == "foto"
    assert classify(spark, 800, 600, uni=0.005, flat=0.72) == "foto"
    assert classify(spark, 800, 600, uni=0.5, grad=1.0, cores=6) == "em_branco"
    assert classify(spark, 800, 600, uni=0.5, white=0.9, sat=5.0) == "assinatura"
    assert classify(spark, 1240, 1754, uni=0.5) == "documento"
    assert classify(spark, 800, 600, uni=0.5, sat=5.0) == "documento"
    assert classify(spark, 800, 600, uni=0.5) == "print_tela"


@pytest.mark.parametrize("given,want", [
    ("2026-01-02T03:04:05.123456+00:00", "2026-01-02 03:04:05.123456"), ("2026-01-02T03:04", "2026-01-02 03:04:00"),
    ("2026-01-02T03:04:05Z", "2026-01-02 03:04:05"), ("2026-01-02 03:04:05+00", "2026-01-02 03:04:05"),
    ("1/2/2026", "2026-01-02 00:00:00"), ("1/2/2026 3:04 pm", "2026-01-02 15:04:00"), ("13/2/2026 3:04", "2026-02-13 03:04:00"),
    ("2026/01/02", "2026-01-02 00:00:00"), ("02 Jan 2026", "2026-01-02 00:00:00"), ("Jan 2, 2026 3:04 AM", "2026-01-02 03:04:00"),
    ("2026-1-2 3:04", "2026-01-02 03:04:00"), ("not a date", None), ("", None)])
def test_dates_of_every_kind(spark, given, want):
    assert one(spark, text.parse_date(F.lit(given)).cast("string")) == (want and want.removesuffix(".000000"))


def test_coordinates_are_tested_before_they_are_rounded(spark):
    at = lambda lat: one(spark, geo.extract_coordinate(F.lit(f"{lat}, -46.633300")))
    edge = geo.LAT_MIN
    assert at(f"{edge - 4e-7:.7f}") is None
