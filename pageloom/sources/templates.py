"""Output templates from JSON or YAML files; read once at planning time."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any


def load_template(path: str | Path) -> dict[str, Any]:
    """The template object of a .json, .yaml or .yml file."""
    file = Path(path)
    if not file.exists():
        raise FileNotFoundError(f"no template at {file}")
    kind = file.suffix.lower()
    content = file.read_text(encoding="utf-8")
    if kind == ".json":
        template = json.loads(content)
    elif kind in (".yaml", ".yml"):
        import yaml

        template = yaml.safe_load(content)
    else:
        raise ValueError(f"template files end in .json, .yaml or .yml, not {kind!r}")
    if not isinstance(template, dict):
        raise ValueError("a template must be an object")
    return template
