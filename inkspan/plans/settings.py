"""Settings: command line over file over default."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The defaults of the page operators.
DEFAULTS = {"dpi": 300, "page_mode": 1, "language": "eng", "engine": "tesseract", "tile": 64, "percentile": 0.95, "inpaint_radius": 3, "background_scale": 0.33, "blur_sigma": 0.8, "min_font_size": 1, "timeout_s": 300}


def overlay(*columns: str) -> Column:
    """The first that isn't null."""
    return F.coalesce(*columns)


def setting(settings: Column, key: Column, default: Column) -> Column:
    """A map's value, or the default where it has none."""
    return F.coalesce(F.try_element_at(settings, key), default)


def strip_comments(text: str) -> str:
    """JSON text without // and /* */ outside its strings."""
    return re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)


_ENTRY = re.compile(r'\s*("(?:\\.|[^"\\])*")\s*:\s*("(?:\\.|[^"\\])*"|true|false|null|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*(,|\}|\Z)', re.S)


def read_object(text: str) -> dict:
    """Entries of a flat JSON object up to the first that can't be read."""
    out, at = {}, m.end() if (m := re.match(r"\s*\{", text)) else len(text)
    while m := _ENTRY.match(text, at):
        out[json.loads(m[1], strict=False)] = json.loads(m[2], strict=False)
        at = m.end()
        if m[3] != ",":
            break
    return out


def load(text: str | None, cli: dict | None = None) -> dict:
    """Settings of a file's text (none: no file) over the defaults, and the command line's over both."""
    return DEFAULTS | read_object(strip_comments(text or "")) | {k: v for k, v in (cli or {}).items() if v is not None}
