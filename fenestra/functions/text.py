"""Text, token and time expressions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import LEVELS, ROLES, UNKNOWN

#: Tokens that mark a failure in a template. Fixed values.
FAILURE_CUES = ("error", "errors", "failed", "failure", "fail", "fatal", "exception", "panic", "refused", "timeout", "aborted", "crash", "crashed", "denied", "unreachable")


def template_id(template: Column) -> Column:
    return F.concat(F.lit("h:"), F.substring(F.sha2(template, 256), 1, 32))


def well_formed(text: Column) -> Column:
    """Ill-formed UTF-8 repaired: each maximal ill-formed part becomes U+FFFD."""
    return F.make_valid_utf8(text)


def cap_text(text: Column, most: int) -> Column:
    """``text`` where it is shorter than ``most`` bytes; else a prefix of whole characters, tildes and 16 hexadecimal
    digits of its SHA-256, ``most`` bytes together."""
    raw = text.cast("binary")
    room = most - 17
    byte = lambda at: F.hex(F.substring(raw, at + 1, 1))
    inside = lambda at: byte(at).between("80", "BF")
    size = F.when(~inside(room), room).when(~inside(room - 1), room - 1).when(~inside(room - 2), room - 2).otherwise(room - 3)
    prefix = F.substr(raw, F.lit(1), size).cast("string")
    capped = F.concat(prefix, F.repeat(F.lit("~"), F.lit(most - 16) - size), F.substring(F.sha2(text, 256), 1, 16))
    return F.when(F.octet_length(text) < most, text).otherwise(capped)


def is_digest_form(text: Column, most: int) -> Column:
    return F.octet_length(text) == most


def display_form(text: Column, most: int) -> Column:
    """A capped text as shown: its prefix and an ellipsis."""
    prefix = F.regexp_replace(F.substr(text, F.lit(1), F.length(text) - 16), "~+$", "")
    return F.when(is_digest_form(text, most), F.concat(prefix, F.lit("…"))).otherwise(text)


def level_token(level: Column) -> Column:
    return F.when(level.isNotNull(), F.get(F.array(*[F.lit(x) for x in LEVELS]), level.cast("int")))


def row_level_token(level: Column) -> Column:
    """The token on a row: none for UNKNOWN."""
    return F.when(level < UNKNOWN, level_token(level))


def level_of(token: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), token)
    return F.when(token.isNull() | (at == 0), F.lit(UNKNOWN)).otherwise(at - 1).cast("int")


def role_name(role: Column) -> Column:
    return F.when(role.isNotNull(), F.get(F.array(*[F.lit(x) for x in ROLES]), role.cast("int")))


def role_of(name: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(x) for x in ROLES]), name)
    return F.when(name.isNull() | (at == 0), F.lit(0)).otherwise(at - 1).cast("int")


def outcome_token(outcome: Column) -> Column:
    """Run outcome on the wire; unknown ones are omitted."""
    names = {"success": "success", "failure": "failure", "unstable": "unstable", "aborted": "aborted", "cancelled": "aborted"}
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.lower(outcome))


def is_failure(level: Column) -> Column:
    return F.coalesce(level.isin(4, 5), F.lit(False))


def failure_cue(template: Column) -> Column:
    """Whether a cue stands in the template as a token of its own, not as part of a file name."""
    words = "|".join(FAILURE_CUES)
    return template.rlike(rf"(?i)(^|[^\w.\-/])({words})(?![\w\-/]|\.\w)")


def format_rfc3339(ts: Column) -> Column:
    return F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_rfc3339(text: Column) -> Column:
    """Exactly 20 bytes, calendar-valid; else null."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
    return F.when(shaped, F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def duration_seconds(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.unix_seconds(end) - F.unix_seconds(start))


def ticks(ts: Column) -> Column:
    return F.unix_micros(ts) * 1000


def shift_label(shift: Column, direction: Column) -> Column:
    return F.when(shift != "None", F.concat(F.when(direction == "Down", F.lit("down_")).otherwise(F.lit("up_")), F.lower(shift)))


def carry_equal(a: Column, b: Column) -> Column:
    """Kept only where both sides declare the same."""
    return F.when(a.eqNullSafe(b), a)
