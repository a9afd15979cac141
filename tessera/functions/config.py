"""Layered settings: defaults, then a file, then the environment, then arguments; checked before use."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path
from typing import Any

# Fixed values of the image service.
SIZES = ("512px", "1K", "2K", "4K")
ASPECTS = ("1:1", "2:3", "3:2", "3:4", "4:3", "4:5", "5:4", "9:16", "16:9", "21:9")
LEVELS = ("off", "low", "medium", "high")
MOST_SIDE = 8192
DEFAULTS: dict[str, Any] = {
    "brief": "brief.md", "references": [], "palette": [], "model": "image-model", "judge": "text-model", "size": "1K", "aspect": "1:1", "candidates": 3, "background": "auto", "sizes": [], "pixel": None, "quantize": False, "budget": 2.0,
    "key": {"tolerance": 30, "despill": True}, "thresholds": {"shape": 0.5, "size": 0.15, "palette": 15, "jump": 0.45}, "out": "out", "ledger": "usage.jsonl", "pricing": {},
    "thinking": {}, "judge_thinking": {}, "context": {"files": []},
}
#: Environment variables and the settings that they override.
ENVIRONMENT = {"TESSERA_MODEL": "model", "TESSERA_JUDGE": "judge", "TESSERA_OUT": "out", "TESSERA_BRIEF": "brief", "TESSERA_BUDGET": "budget"}


def merge(base: dict, over: dict) -> dict:
    """Objects are merged key by key; lists and single values replace what was there."""
    return base | {k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def normal_hex(text: Any) -> str | None:
    """#rrggbb of #rgb or #rrggbb, else nothing."""
    m = re.fullmatch(r"#([0-9a-f]{3}|[0-9a-f]{6})", str(text).strip().lower())
    return m and "#" + (m[1] if len(m[1]) == 6 else "".join(c * 2 for c in m[1]))


# A schema is a tree of kinds. A kind is a function from a value to (value in its one form, what is expected instead or None).


def one_of(*allowed):
    return lambda v: (v, None if v in allowed else "one of " + " / ".join(map(str, allowed)))


def number(low: float, high: float, whole: bool = False, empty: bool = False):
    types = int if whole else (int, float)
    span = f"{'an integer' if whole else 'a number'} in [{low:g}, {high:g}]"
    return lambda v: (v, None if (empty and v is None) or (isinstance(v, types) and not isinstance(v, bool) and low <= v <= high) else span)


def flag(v):
    return v, None if v is True or v is False else "a boolean"


def words(v):
    return v, None if isinstance(v, str) and v.strip() else "a non-empty string"


def colour(v):
    hex_ = normal_hex(v)
    return hex_, None if hex_ else "a hex colour"


def size(v):
    """(width, height) of `N` or `WxH`."""
    sides = [part.strip() for part in re.split("[x×]", str(v).lower())]
    if not 1 <= len(sides) <= 2 or not all(x.isdecimal() and 0 < int(x) <= MOST_SIDE for x in sides):
        return v, f"N or WxH with sides of 1 to {MOST_SIDE}"
    return (int(sides[0]), int(sides[-1])), None


def either(fixed: tuple, kind):
    return lambda v: (v, None) if v is None and None in fixed or isinstance(v, str) and v in fixed else kind(v)


def each(kind):
    def check_all(v):
        if not isinstance(v, list):
            return v, "a list"
        got = [kind(x) for x in v]
        wrong = next((w for _, w in got if w), None)
        return [x for x, _ in got], wrong and f"a list, each {wrong}"

    return check_all


#: The settings that have rules; "a.b" is within the object a, and "?" marks one that may be left out.
SCHEMA = {
    "budget": number(0, 1e12, empty=True), "candidates": number(1, 8, whole=True), "quantize": flag, "size": one_of(*SIZES), "aspect": one_of(*ASPECTS),
    "background": either((None, "auto"), colour), "palette": each(colour), "sizes": each(size), "references": each(words),
    **{name: words for name in ("brief", "ledger", "out", "model", "judge")},
    "key.tolerance": number(1, 80), "key.despill": flag, "pixel.grid?": number(4, 512, whole=True), "pixel.colors?": number(2, 256, whole=True),
    **{f"{part}.{name}?": kind for part in ("thinking", "judge_thinking") for name, kind in (("level", one_of(*LEVELS)), ("budget", number(0, 2**31, whole=True)))},
    "thresholds.shape": number(0, 1), "thresholds.size": number(0, 1), "thresholds.palette": number(0, 200), "thresholds.jump": number(0, 1), "context.files?": each(words),
}
#: Objects, and whether null stands for none.
OBJECTS = {"key": False, "pixel": True, "thinking": False, "judge_thinking": False, "thresholds": False, "pricing": False, "context": False}


def problems(settings: dict) -> tuple[dict, list[str]]:
    """The settings with every value in its one form, and a line for each that no rule allows."""
    wrong = [f"{name}: expected an object" for name, empty in OBJECTS.items() if not (isinstance(settings.get(name), dict) or empty and settings.get(name) is None)]
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in settings.items()}
    for path, kind in SCHEMA.items():
        *owner, leaf = path.rstrip("?").split(".")
        home = out if not owner else out.get(owner[0])
        if not isinstance(home, dict) or (path.endswith("?") and leaf not in home):
            continue  # an object that is no object has its own line, and one that is null has no rules
        home[leaf], expected = kind(home.get(leaf))
        if expected:
            wrong.append(f"{path.rstrip('?')}: expected {expected}")
    return out, wrong


def check(settings: dict) -> dict:
    """The settings in one form; all that is wrong with them is one error."""
    out, wrong = problems(settings)
    if wrong:
        raise ValueError("; ".join(wrong))
    return out


def load(path: str | None = None, arguments: dict | None = None, env: dict | None = None) -> dict:
    """Settings from all layers. A file that is named must be there and be JSON."""
    file = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    env = os.environ if env is None else env
    outer = {setting: float(env[name]) if setting == "budget" else env[name] for name, setting in ENVIRONMENT.items() if env.get(name)}
    return check(merge(merge(merge(DEFAULTS, file), outer), arguments or {}))
