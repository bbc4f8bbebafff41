"""Configuration lines and the envelope of a command's answer."""

from __future__ import annotations

KEYS = {"staleness_window_days": 365, "default_budget": 256, "max_attempts": 3}


def parse(text: str) -> dict[str, int]:
    """`key = number` lines with # comments; any other line is an error."""
    out = dict(KEYS)
    for n, line in enumerate(text.splitlines(), 1):
        line = line.partition("#")[0].strip()
        if not line:
            continue
        key, eq, value = (x.strip() for x in line.partition("="))
        if not eq or key not in KEYS or not value.isascii() or not value.isdigit():
            raise ValueError(f"config_parse: line {n}: {line!r}; expected one of {', '.join(KEYS)} = <number>")
        out[key] = int(value)
    return out


def envelope(kind: str, data: dict) -> dict:
    return {"ok": True, "envelope_version": 1, "envelope_kind": kind, "data": data}


def refusal(code: str, message: str, remediation: str) -> dict:
    if not remediation:
        raise ValueError("an error says what to do about it")
    return {"ok": False, "envelope_version": 1, "envelope_kind": "error", "data": {"code": code, "message": message, "remediation": remediation}}
