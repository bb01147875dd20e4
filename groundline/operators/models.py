"""Models: anything with ``infer(prompt)``; adapters by name; offline models for tests and replays."""

from __future__ import annotations

import json
import re
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib import import_module
from operator import attrgetter
from typing import Any, NamedTuple, Protocol

from ..config import config
from ..errors import InvalidModelConfigError, ProviderConfigError
from .prompts import CONTRACT, TEXT


class InferenceResult(NamedTuple):
    text: str
    raw: Any = None


class Model(Protocol):
    def infer(self, prompt: str) -> Any: ...


def checked(model: Any) -> Any:
    if not callable(getattr(model, "infer", None)):
        raise InvalidModelConfigError("model must respond to infer(prompt)")
    return model


def call(model: Model, prompt: str) -> str:
    """The text of a model's answer: its ``text`` if it has one, else the answer as text."""
    result = model.infer(prompt=prompt)
    text = getattr(result, "text", result)
    return "" if text is None else str(text)


@dataclass(frozen=True)
class ModelConfig:
    """What a model is made from. Credentials are no part of it."""

    adapter: str = "chat"
    provider: str | None = None
    model: str | None = None
    options: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if self.model is None:
            object.__setattr__(self, "model", config().default_model)
        for name, value in (("adapter", self.adapter), ("provider", self.provider), ("model", self.model)):
            if value == "" or (name == "adapter" and value is None):
                raise InvalidModelConfigError(f"{name} cannot be blank")

    def to_dict(self) -> dict[str, Any]:
        return {"adapter": self.adapter, "provider": self.provider, "model": self.model, "options": dict(self.options)}


class Provider(ABC):
    """Base of adapters: made from a ModelConfig."""

    def __init__(self, config: ModelConfig):
        self.config = config

    @abstractmethod
    def infer(self, prompt: str) -> InferenceResult: ...


class ChatProvider(Provider):
    """A chat client from ``options['client']``: a callable that takes (prompt, model, provider, **options), or its name as "module:name", which is imported where the model is asked, so that nothing but the name is sent there."""

    def infer(self, prompt: str) -> InferenceResult:
        options = dict(self.config.options)
        client = options.pop("client", None)
        if client is None:
            raise ProviderConfigError("the chat adapter needs a client")
        try:
            if isinstance(client, str):
                module, _, name = client.partition(":")
                client = attrgetter(name)(import_module(module))
            raw = client(prompt, model=self.config.model, provider=self.config.provider, **options)
        except Exception as e:
            raise ProviderConfigError(f"provider failed: {e}") from e
        content = getattr(raw, "content", None)
        text = content if content is not None else getattr(raw, "text", raw)
        return InferenceResult(str(text), raw)


class Router:
    """Adapters by name."""

    def __init__(self):
        self._known: dict[str, Callable[[ModelConfig], Any]] = {}

    def register(self, name: str, make: Callable[[ModelConfig], Any]) -> None:
        self._known[str(name)] = make

    def fetch(self, name: str) -> Callable[[ModelConfig], Any]:
        if name not in self._known:
            raise InvalidModelConfigError(f"unknown provider adapter: {name}")
        return self._known[name]

    def create(self, config: ModelConfig) -> Any:
        return self.fetch(config.adapter)(config)

    @property
    def names(self) -> list[str]:
        return sorted(self._known)


_router: Router | None = None


def router() -> Router:
    global _router
    if _router is None:
        _router = Router()
        _router.register("chat", ChatProvider)
    return _router


def reset_router() -> None:
    global _router
    _router = None


def create_model(config: ModelConfig | None = None) -> Any:
    return router().create(config or ModelConfig())


def chunk_text(prompt: str) -> str:
    """The text section of a prompt made by ``prompts``."""
    body = prompt[: -len(CONTRACT) - 2] if prompt.endswith("\n\n" + CONTRACT) else prompt
    return body[body.rindex("\n\n" + TEXT) + 2 + len(TEXT) :] if "\n\n" + TEXT in body else body


@dataclass(frozen=True)
class RegexModel:
    """Offline and deterministic: every match of a class's pattern in the prompt's text is an extraction, class by class."""

    patterns: dict[str, str]

    def infer(self, prompt: str) -> InferenceResult:
        text = chunk_text(prompt)
        found = [{"extraction_class": name, "text": m[0]} for name, p in self.patterns.items() for m in re.finditer(p, text) if m[0]]
        return InferenceResult(json.dumps({"extractions": found}, ensure_ascii=False))


@dataclass(frozen=True)
class ConstantModel:
    output: str

    def infer(self, prompt: str) -> str:
        return self.output


@dataclass(frozen=True)
class ReplayModel:
    """Recorded answers by prompt."""

    answers: dict[str, str]

    def infer(self, prompt: str) -> str:
        if prompt not in self.answers:
            raise ProviderConfigError("no recorded answer for this prompt")
        return self.answers[prompt]
