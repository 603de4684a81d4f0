"""Style presets: small configuration, read on the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The defaults of a chapter style and of a volume style.
CHAPTER_STYLE = {"align": "center", "color": "", "size": "1.5em", "underline": False, "split": False, "num_color": "", "num_size": "1em", "desc": ""}
VOLUME_STYLE = {"vol_split": True, "vol_num_color": "#555555", "vol_num_size": "1.2em", "vol_color": "#8B0000", "vol_size": "2.5em", "vol_gap": "0.6em", "desc": ""}


def _filled(style: dict, defaults: dict) -> dict:
    return {k: type(d)(style.get(k, d)) for k, d in defaults.items()}


def parse_styles(text: str | None) -> dict[str, dict[str, dict]]:
    """{"chapter": presets, "volume": presets}; a flat object is chapter presets, unreadable text has none, bad presets are left out."""
    try:
        data = json.loads(text or "")
    except ValueError:
        data = None
    if not isinstance(data, dict):
        return {"chapter": {}, "volume": {}}
    if not {"chapter", "volume"} & data.keys():
        data = {"chapter": data}
    chapter = {n: _filled(s, CHAPTER_STYLE) for n, s in data.get("chapter", {}).items() if isinstance(s, dict) and s.get("align", "center") in ("center", "left")}
    volume = {n: _filled(s, VOLUME_STYLE) for n, s in data.get("volume", {}).items() if isinstance(s, dict)}
    return {"chapter": chapter, "volume": volume}


#: What a missing style file is written as.
SAMPLE = {"chapter": {"default": CHAPTER_STYLE, "split_title": CHAPTER_STYLE | {"split": True}}, "volume": {"default": VOLUME_STYLE}}


def load_presets(path: str) -> dict[str, dict[str, dict]]:
    """The presets of a style file on the driver; a missing file is written as a sample first, an unreadable one has none."""
    file = Path(path)
    try:
        if not file.exists():
            file.write_text(json.dumps(SAMPLE, ensure_ascii=False, indent=4) + "\n", encoding="utf-8")
        return parse_styles(file.read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError):
        return parse_styles(None)


def resolve_style(presets: dict[str, dict], name: str | None, defaults: dict, **given) -> dict:
    """A preset by name with explicit arguments over it; KeyError for an unknown name."""
    if name is not None and name not in presets:
        raise KeyError(f"no preset {name!r}; there are {', '.join(sorted(presets)) or 'none'}")
    return defaults | (presets[name] if name is not None else {}) | {k: v for k, v in given.items() if v is not None}


def image_quality(value: int | None) -> int | None:
    """A JPEG quality of 1 .. 100; anything else switches re-encoding off."""
    return value if value is not None and 1 <= value <= 100 else None


def _field(value: Column, default: object) -> Column:
    """A field of a preset as text, in the type of its default; a flag is off for an empty value."""
    if isinstance(default, bool):
        return F.when(value.isNull(), F.lit(default)).otherwise(~value.isin("false", "", "0", "[]", "{}"))
    return F.coalesce(value, F.lit(default))


def preset_rows(configs: DataFrame, by: str, section: str, defaults: dict) -> DataFrame:
    """(by, preset, fields...) of style files (by, json): the presets of a section, ``chapter`` or ``volume``, every field filled.

    As parse_styles: a flat object is chapter presets, unreadable text has none, presets that are no objects or, of chapters, have an odd align are left out.
    """
    top = F.from_json("json", "map<string,string>")
    flat = F.size(F.array_intersect(F.map_keys("top"), F.array(F.lit("chapter"), F.lit("volume")))) == 0
    named = F.from_json(F.col("top")[section], "map<string,string>")
    own = F.when(flat, F.col("top")).otherwise(named) if section == "chapter" else F.when(~flat, named)
    each = configs.select(by, top.alias("top")).select(by, F.explode(own).alias("preset", "raw"))
    style = each.where(F.col("raw").rlike(r"^\s*\{")).select(by, "preset", F.from_json("raw", "map<string,string>").alias("style")).where("style is not null")
    rows = style.select(by, "preset", *[_field(F.col("style")[k], d).alias(k) for k, d in defaults.items()])
    return rows.where(F.col("align").isin("center", "left")) if section == "chapter" else rows


def resolved_styles(choices: DataFrame, presets: DataFrame, by: str, defaults: dict) -> DataFrame:
    """choices (by, preset, given map<string,string>) with the fields of the preset that each names, given ones over them, and known: false for a
    name that there is not, which has the defaults; null names no preset."""
    held = presets.select(F.col(by).alias("_of"), F.col("preset").alias("_name"), F.struct(*defaults).alias("_style"))
    rows = choices.join(held, F.col(by).eqNullSafe(F.col("_of")) & (F.col("preset") == F.col("_name")), "left")
    given = F.coalesce("given", F.create_map().cast("map<string,string>"))
    fields = [_field(F.coalesce(given[k], F.col(f"_style.{k}").cast("string")), d).alias(k) for k, d in defaults.items()]
    return rows.select(*choices.drop("given").columns, (F.col("preset").isNull() | F.col("_name").isNotNull()).alias("known"), *fields)
