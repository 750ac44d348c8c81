"""Job files and settings: YAML on the driver, one row a job."""

from __future__ import annotations

import os
from typing import Any

import yaml

from palimpsest.functions.paging import DEFAULTS, MODES

_SCALARS = ("color_mode", "dpi", "fg_dpi", "bg_quality", "fg_quality", "linearize")


class ConfigFault(ValueError):
    """A job or settings file that can't be used."""


def parse_pages(spec: Any) -> list[int] | None:
    """Pages of a list form: a range text, or a list of numbers and range texts."""
    if spec is None:
        return None
    parts = spec if isinstance(spec, list) else [spec]
    pages: set[int] = set()
    for part in parts:
        if isinstance(part, bool) or not isinstance(part, int | str):
            raise ConfigFault(f"not a page list: {part!r}")
        if isinstance(part, int):
            if part < 0:
                raise ConfigFault(f"not a page number: {part}")
            pages.add(part)
            continue
        found = [x.strip() for x in part.split(",") if x.strip()]
        if not found:
            raise ConfigFault("empty page range")
        for item in found:
            low, dash, high = (x.strip() for x in item.partition("-"))
            high = high if dash else low
            if not (low.isascii() and low.isdigit() and high.isascii() and high.isdigit()):
                raise ConfigFault(f"not a page number: {item!r}")
            if int(low) > int(high):
                raise ConfigFault(f"range starts after its end: {item!r}")
            pages.update(range(int(low), int(high) + 1))
    if not pages:
        raise ConfigFault("no pages")
    return sorted(pages)


def parse_settings(text: str) -> dict[str, Any]:
    """Settings with defaults; unknown keys are ignored."""
    found = yaml.safe_load(text) or {}
    if not isinstance(found, dict):
        raise ConfigFault("settings must be a mapping")
    out = DEFAULTS | {k: v for k, v in found.items() if k in DEFAULTS and v is not None}
    if out["color_mode"] not in MODES:
        raise ConfigFault(f"unknown color mode: {out['color_mode']}")
    return out


def settings_beside(job_file: str) -> dict[str, Any]:
    """settings.yaml in the job file's folder, else the defaults."""
    path = os.path.join(os.path.dirname(job_file), "settings.yaml")
    if not os.path.exists(path):
        return dict(DEFAULTS)
    with open(path, encoding="utf-8") as f:
        return parse_settings(f.read())


def page_overrides(job: dict[str, Any]) -> dict[int, str]:
    """Mode by page (from 1); a page in two lists is an error naming both."""
    out: dict[int, str] = {}
    for mode in MODES:
        for page in parse_pages(job.get(f"{mode}_pages")) or ():
            if page in out:
                raise ConfigFault(f"page {page} is listed as {out[page]} and {mode}")
            out[page] = mode
    return out


def parse_jobs(text: str, settings: dict[str, Any] | None = None, folder: str = "") -> list[dict[str, Any]]:
    """Merged jobs: a job's value, else the settings', else the default. Input
    and output are taken relative to folder; the cache folder is not."""
    settings = DEFAULTS | (settings or {})
    found = yaml.safe_load(text)
    if not isinstance(found, dict) or not isinstance(found.get("jobs"), list):
        raise ConfigFault("a job file needs a list of jobs")
    out = []
    for job in found["jobs"]:
        if not isinstance(job, dict) or not job.get("input") or not job.get("output"):
            raise ConfigFault("a job needs input and output")
        merged = {k: job[k] if job.get(k) is not None else settings[k] for k in _SCALARS}
        if merged["color_mode"] not in MODES:
            raise ConfigFault(f"unknown color mode: {merged['color_mode']}")
        paths = {k: os.path.join(folder, str(job[k])) for k in ("input", "output")}
        out.append(merged | paths | {"overrides": page_overrides(job), "cache_dir": settings["cache_dir"]})
    return out


def load_jobs(paths: list[str]) -> list[dict[str, Any]]:
    """Jobs of all files; one bad file fails all."""
    out = []
    for path in paths:
        with open(path, encoding="utf-8") as f:
            out += parse_jobs(f.read(), settings_beside(path), os.path.dirname(path))
    return out
