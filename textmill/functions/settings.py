"""Settings from the environment."""

from __future__ import annotations

import os


def number_setting(name: str, default: int) -> int:
    """A whole number from the environment, or the default where it is unset or empty. Anything
    else is an error that names the setting."""
    raw = os.environ.get(name, "").strip()
    if not raw:
        return default
    try:
        return int(raw)
    except ValueError:
        raise ValueError(f"Error: {name} must be a whole number, not {raw!r}.") from None
