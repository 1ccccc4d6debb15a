"""Text and identity functions: Column in, Column out, all inside of the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space: the Unicode spaces and the four separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def normalize_text(text: Column) -> Column:
    """White space collapsed and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " "))


def sha256_hex(text: Column) -> Column:
    return F.upper(F.sha2(text, 256))


def stable_id(kind: Column, location: Column, text: Column | None = None, digest: Column | None = None) -> Column:
    """``KIND-`` and 12 hex digits of the SHA-256 of the four parts joined by bars; nulls count as empty."""
    parts = [F.coalesce(p, F.lit("")) if p is not None else F.lit("") for p in (kind, location, text, digest)]
    return F.concat(F.upper(parts[0]), F.lit("-"), F.substring(sha256_hex(F.concat_ws("|", *parts)), 1, 12))


def canonical_json(fields: dict[str, Column]) -> Column:
    """One flat object as canonical JSON: keys sorted, nulls kept, no spaces."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def prefixed_digest(prefix: str, *parts: Column) -> Column:
    """An id of the given prefix over the parts, which are joined by U+001F."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(sha256_hex(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 16))


def excerpt(text: Column, start: Column, end: Column, radius: int = 36) -> Column:
    """The surroundings of ``text[start:end]`` (code points from 0)."""
    low = F.greatest(F.lit(0), start - radius)
    return F.substring(text, low + 1, F.least(F.length(text), end + radius) - low)


def safe_filename(value: Column, limit: int = 120) -> Column:
    """A name without path separators, control and reserved characters, dots or spaces at its end; empty becomes ``_``."""
    name = F.regexp_replace(F.coalesce(value, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]+', "_")
    name = F.regexp_replace(F.substring(name, 1, limit), r"[. ]+$", "")
    return F.when(name == "", "_").otherwise(name)


def artifact_stem(model: Column, full_name: Column, suffix: str = "产品介绍") -> Column:
    """``<model>_<name>-<suffix>`` of cleaned parts."""
    return F.concat(safe_filename(model), F.lit("_"), safe_filename(full_name), F.lit(f"-{suffix}"))


def preview_text(text: Column, maximum: int = 1200, more: str = "……") -> Column:
    """A readable preview: control characters dropped, spaces collapsed in each line, runs of blank lines made one,
    cut at ``maximum`` code points with a mark that counts towards them."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    clean = F.regexp_replace(clean, r"\r\n?", "\n")
    clean = F.regexp_replace(clean, r"[ \t]+", " ")
    clean = F.regexp_replace(clean, r" ?\n ?", "\n")
    clean = F.regexp_replace(clean, r"\n{3,}", "\n\n")
    clean = F.regexp_replace(clean, r"^[ \n]+|[ \n]+$", "")
    cut = F.concat(F.regexp_replace(F.substring(clean, 1, maximum - len(more)), r"[ \n]+$", ""), F.lit(more))
    return F.when(F.length(clean) <= maximum, clean).otherwise(cut)


def title_token(text: Column) -> Column:
    """A heading for comparison: block marks and all white space removed."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"{SPACE}|[▌▎]", "")


def json_pointer(document: Column, pointer: str) -> Column:
    """The text at a pointer (``/a/0/b``) of a JSON text; null where it leads nowhere."""
    path = "$"
    for part in pointer.split("/")[1:]:
        key = part.replace("~1", "/").replace("~0", "~")
        path += f"[{key}]" if key.isdigit() else f"['{key}']"
    return F.get_json_object(document, path)


def first_of(origins: dict[str, Column], value: str, origin: str) -> tuple[Column, Column]:
    """The first value that isn't blank, and the name of the origin it comes from."""
    given = {name: F.when(F.trim(c) != "", F.trim(c)) for name, c in origins.items()}
    return F.coalesce(*given.values()).alias(value), F.coalesce(*(F.when(c.isNotNull(), F.lit(name)) for name, c in given.items())).alias(origin)


def composed(text: Column) -> Column:
    """A text in NFC, in Arrow batches: the engine has no function for it. Only texts that hold a mark are sent there."""
    nfc = F.pandas_udf(lambda values: values.map(lambda v: v if v is None else unicodedata.normalize("NFC", v)), "string", F.PandasUDFType.SCALAR)

    return F.when(text.rlike(r"[^\x00-\x{2ff}\x{3000}-\x{303f}\x{4e00}-\x{9fff}\x{ff00}-\x{ffef}]"), nfc(text)).otherwise(text)
