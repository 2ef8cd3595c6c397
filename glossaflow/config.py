"""Settings: defaults, then files, then arguments, each over the one before; several dictionaries in numbered sections."""

from __future__ import annotations

import configparser
import json
from dataclasses import dataclass, field, fields, replace

TRUE, FALSE = {"1", "true", "on", "yes"}, {"0", "false", "off", "no"}


@dataclass(frozen=True)
class Dictionary:
    """One term list and how it is compared."""

    path: str = ""
    layout: str = "bth"
    skip_header: bool = False
    normalize: str = "lowercase"
    stopwords: str = ""
    term_token: str = ""
    abbrev_detection: bool = False
    match_hook: str = ""
    extra_fields: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Settings:
    """What a run loads, recognises, filters and writes."""

    input_directory: str = "."
    output_directory: str = "."
    pointers: list[str] = field(default_factory=list)
    pointer_type: str = "glob"
    article_format: str = "txt"
    fallback_format: str = ""
    export_format: list[str] = field(default_factory=lambda: ["tsv"])
    fn_format_in: str = "{id}.txt"
    fn_format_fallback: str = ""
    index_cache: str = ""
    single_section: bool = False
    sentence_split: bool = False
    include_header: bool = False
    include_mesh: bool = False
    mesh_as_entities: bool = False
    ignore_load_errors: bool = False
    postfilter: list[str] = field(default_factory=list)
    brat_attributes: list[str] = field(default_factory=list)
    conll_tagset: str = "IOBES"
    sentence_level: bool = False
    byte_offsets_in: bool = False
    byte_offsets_out: bool = False
    dictionaries: list[Dictionary] = field(default_factory=list)


def _value(kind: str, raw):
    """A value of a field from text: booleans by word, lists as JSON arrays or parted by blanks."""
    if not isinstance(raw, str):
        return raw
    text = raw.strip()
    if kind == "bool":
        if text.lower() in TRUE | FALSE:
            return text.lower() in TRUE
        raise ValueError(f"not a boolean: {raw}")
    if kind == "int":
        return int(text)
    if kind.startswith("list"):
        return json.loads(text) if text.startswith("[") else text.split()
    return text


def _with(target, values: dict):
    known = {f.name: str(f.type) for f in fields(target)}
    named = {k.replace("-", "_"): v for k, v in values.items()}
    if unknown := sorted(set(named) - set(known)):
        raise ValueError(f"unknown setting(s): {', '.join(unknown)}")
    return replace(target, **{k: _value(known[k], v) for k, v in named.items()})


def load(paths: list[str] = (), **arguments) -> Settings:
    """Settings of INI files in order, then of arguments. Dashes in names equal underscores; unknown names raise.

    [Main] has the general settings, [Termlist] the defaults of all dictionaries and [Termlist<N>] one each, in order of N;
    other sections are left alone. ${Section:name} takes a value from elsewhere.
    """
    parser = configparser.ConfigParser(interpolation=configparser.ExtendedInterpolation(), default_section="\x00")
    for p in paths:
        with open(p, encoding="utf-8") as lines:
            parser.read_file(lines)
    out = _with(Settings(), dict(parser["Main"]) if "Main" in parser else {})
    base = _with(Dictionary(), dict(parser["Termlist"]) if "Termlist" in parser else {})
    numbered = sorted((s for s in parser.sections() if s.startswith("Termlist") and s[8:].isdigit()), key=lambda s: int(s[8:]))
    lists = [_with(base, dict(parser[s])) for s in numbered] or ([base] if base.path else [])
    return _with(replace(out, dictionaries=lists), arguments)
