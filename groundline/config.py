"""Settings for the whole process."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Config:
    default_model: str | None = field(default_factory=lambda: os.environ.get("GROUNDLINE_MODEL"))
    logger: logging.Logger = field(default_factory=lambda: logging.getLogger("groundline"))


_current = Config()


def config() -> Config:
    return _current


def configure(change: Callable[[Config], None] | None = None, **values) -> Config:
    """Sets attributes by name, or lets ``change`` set them."""
    for name, value in values.items():
        if not hasattr(_current, name):
            raise AttributeError(name)
        setattr(_current, name, value)
    if change:
        change(_current)
    return _current


def reset_configuration() -> None:
    """Settings and registered adapters as they were at the start."""
    global _current
    _current = Config()
    from .operators import models

    models.reset_router()
