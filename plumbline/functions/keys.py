"""Column expressions over ids and free text: group keys, labels, tags, defaults."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label spaces, display names and the id separator of the corpora.
SPLICE = "___"
SIX_CLASSES = ["ANG", "DIS", "FEA", "HAP", "NEU", "SAD"]
SEVEN_CLASSES = ["anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise"]
DISPLAY_NAMES = {
    "ANG": "Angry",
    "DIS": "Disgust",
    "FEA": "Fearful",
    "HAP": "Happy",
    "NEU": "Neutral",
    "SAD": "Sad",
}
GENUINE, TAMPERED, SPLICED = "Genuine Pairs", "Emotion Tampering", "Cross-Identity Spliced"
INAUDIBLE = "[inaudible]"

#: White space as a regular-expression class (ASCII, separators and line breaks).
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: White space at either end; the look-behind keeps long inner runs linear.
_ENDS = rf"^{SPACE}++|(?<!{SPACE}){SPACE}++\z"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(col: Column | str) -> Column:
    """Remove white space at both ends (``trim`` alone removes only blanks)."""
    return F.regexp_replace(as_col(col), _ENDS, "")


def source_group(col: Column | str) -> Column:
    """Leading token of the first id component: what must not cross a split."""
    return F.substring_index(F.substring_index(as_col(col), SPLICE, 1), "_", 1)


def donor_group(col: Column | str) -> Column:
    """Leading token of the second id component; the source group if there is none."""
    c = as_col(col)
    donor = F.split_part(c, F.lit(SPLICE), F.lit(2))
    return F.when(c.contains(SPLICE), F.substring_index(donor, "_", 1)).otherwise(source_group(c))


def _position(key: Column, names: Sequence[str]) -> Column:
    """0-based position of a key in a fixed list, -1 when it is not there.

    A map lookup would be rewritten to a CASE that evaluates the key once per entry.
    """
    return F.array_position(F.array(*[F.lit(n) for n in names]), key) - 1


def label_from_token(col: Column | str, names: Sequence[str], pos: int = 2) -> Column:
    """Label index from one token of an id; NULL when the token is absent or unknown."""
    return encode_labels(F.get(F.split(as_col(col), "_"), F.lit(pos)), names)


def label_from_text(col: Column | str, names: Sequence[str]) -> Column:
    """Label index from free text, ignoring case and surrounding white space."""
    return encode_labels(F.lower(strip(col)), names)


def encode_labels(col: Column | str, names: Sequence[str]) -> Column:
    """Position of an exact name in ``names``; NULL when unknown."""
    return F.nullif(_position(as_col(col), names), F.lit(-1)).cast("int")


def decode_labels(col: Column | str, names: Sequence[str]) -> Column:
    """Name at an index; NULL outside the label space."""
    return F.get(F.array(*[F.lit(n) for n in names]), as_col(col))


def display_name(col: Column | str, names: Mapping[str, str] = DISPLAY_NAMES) -> Column:
    """Display name of a code; NULL when unknown."""
    return decode_labels(_position(as_col(col), list(names)).cast("int"), list(names.values()))


def dataset_of(col: Column | str, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Tag of the first rule whose substring occurs in the lower-cased value."""
    low = F.lower(as_col(col))
    out = F.lit(default)
    for part, tag in reversed(list(rules)):
        out = F.when(low.contains(part), F.lit(tag)).otherwise(out)
    return out


def pair_type(label: Column | str, source: Column | str, tampered_source: object) -> Column:
    """Pair type from the label and the source tag of the forged rows."""
    return (F.when(as_col(label) == 0, GENUINE)
            .when(as_col(source) == F.lit(tampered_source), TAMPERED)
            .otherwise(SPLICED))


def pair_type_from_id(label: Column | str, file_id: Column | str) -> Column:
    """Pair type from the label and the form of the id."""
    return (F.when(as_col(label) == 0, GENUINE)
            .when(as_col(file_id).contains(SPLICE), SPLICED)
            .otherwise(TAMPERED))


def text_or_default(col: Column | str, default: str = INAUDIBLE) -> Column:
    """Stripped text; ``default`` when nothing is left."""
    return F.coalesce(F.nullif(strip(col), F.lit("")), F.lit(default))


def clean_transcript(col: Column | str) -> Column:
    """Lower-case text without punctuation."""
    return F.regexp_replace(F.lower(as_col(col)), r"[\p{Punct}]", "")


def count_or_zero(col: Column | str) -> Column:
    """Whole number held as text; 0 when it is absent or not a whole number.

    Surrounding white space, a sign and single underscores between digits are
    allowed.  Values beyond 64 bits saturate, which keeps every comparison right.
    """
    def parse(t: Column) -> Column:
        saturated = F.when(t.startswith("-"), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
        return (F.when(t.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"),
                       F.coalesce(F.regexp_replace(t, "_", "").try_cast("bigint"), saturated))
                .otherwise(F.lit(0).cast("bigint")))
    return F.coalesce(let(strip(col), parse), F.lit(0).cast("bigint"))
