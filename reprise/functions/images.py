"""What an image is, judged from cheap measures of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------------------------------------------------
PHOTO, SCREEN, DOCUMENT = "foto", "print_tela", "documento"
SIGNATURE, BLANK, LOGO, UNDEFINED = "assinatura", "em_branco", "logo", "indefinido"
CLASS_LABELS = {
    "foto": "Foto de vistoria",
    "print_tela": "Print de tela",
    "documento": "Documento / planilha",
    "assinatura": "Assinatura",
    "em_branco": "Área em branco",
    "logo": "Logo / ícone",
    "indefinido": "Indefinido",
}
UNIFORMITY_LIMIT = 0.005
FLAT_LIMIT = 0.72
LOGO_SIDE = 400
BLANK_GRADIENT, BLANK_COLOURS = 1.5, 6
SIGNATURE_WHITE, LOW_SATURATION = 0.88, 12
A4_TALL, A4_TALL_SLACK = 0.707, 0.02
A4_WIDE, A4_WIDE_SLACK = 1.414, 0.03
CAMERA_SLACK = 0.02
DISCARDED_SHA = "90cb2766e81912dd996d8387e2406a32e333836543dd88fc1845aa188e5bdce4"
MIN_WIDTH, MIN_HEIGHT = 120, 120
# ----------------------------------------------------------------------------------------------------------------------


def aspect(width: Column, height: Column) -> Column:
    """Null when a side is unknown or zero."""
    return F.try_divide(F.nullif(width, F.lit(0)), F.nullif(height, F.lit(0)))


def camera_aspect(width: Column, height: Column, inclusive: bool = True) -> Column:
    """4:3 or 3:4 within the slack; cases accept the limit itself, the geographic check does not."""
    ratio = aspect(width, height)
    gaps = [F.abs(ratio - 4 / 3), F.abs(ratio - 3 / 4)]
    tests = [(g <= CAMERA_SLACK) if inclusive else (g < CAMERA_SLACK) for g in gaps]
    return F.coalesce(tests[0] | tests[1], F.lit(False))


def geo_photo(width: Column, height: Column, file_name: Column) -> Column:
    """Camera photo filed under a school id: the only kind that carries a stamp."""
    return camera_aspect(width, height, inclusive=False) & F.coalesce(file_name.rlike("^[0-9]{8}"), F.lit(False))


def classify(
    width: Column, height: Column, uniformity: Column, flat: Column, gradient: Column, white: Column,
    saturation: Column, colours: Column, stamped: Column,
) -> Column:
    """Ordered rules, strongest evidence first. A null uniformity means the image was not measured."""
    stamped = F.coalesce(stamped, F.lit(False))
    ratio = aspect(width, height)
    a4 = F.coalesce(
        (F.abs(ratio - A4_TALL) < A4_TALL_SLACK) | (F.abs(ratio - A4_WIDE) < A4_WIDE_SLACK), F.lit(False)
    )
    longest = F.greatest(F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0)))
    return (
        F.when(uniformity.isNull() & stamped, PHOTO)
        .when(uniformity.isNull(), UNDEFINED)
        .when(longest < LOGO_SIDE, LOGO)
        .when(stamped, PHOTO)
        .when((uniformity <= UNIFORMITY_LIMIT) & (flat <= FLAT_LIMIT), PHOTO)
        .when((gradient < BLANK_GRADIENT) & (colours <= BLANK_COLOURS), BLANK)
        .when((white >= SIGNATURE_WHITE) & (saturation < LOW_SATURATION), SIGNATURE)
        .when(a4, DOCUMENT)
        .when(saturation < LOW_SATURATION, DOCUMENT)
        .otherwise(SCREEN)
    )


def class_label(c: Column) -> Column:
    out = F.lit(CLASS_LABELS[UNDEFINED])
    for key, label in CLASS_LABELS.items():
        out = F.when(c == key, label).otherwise(out)
    return out


def is_evidence(c: Column) -> Column:
    return c == PHOTO
