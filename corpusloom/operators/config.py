"""Settings, resolved on the driver: TOML file, environment, defaults.  Keys stay here and never enter a column."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field


def load_config(path: str = "config/config.toml") -> dict:
    with open(path, "rb") as f:
        return tomllib.load(f)


@dataclass(frozen=True)
class Provider:
    base_url: str
    model: str
    key_field: str
    key_env: str
    display_name: str


#: Placeholders; register real providers with their own addresses.
PROVIDERS = {
    "primary": Provider("https://primary.invalid", "chat", "primary_api_key", "PRIMARY_API_KEY", "Primary"),
    "secondary": Provider("https://secondary.invalid/v1", "chat", "secondary_api_key", "SECONDARY_API_KEY", "Secondary"),
}


@dataclass(frozen=True)
class Settings:
    provider: str
    display_name: str
    base_url: str
    model: str
    temperature: float
    api_key: str = field(repr=False)
    extra_headers: dict[str, str] | None = None


def resolve(config: Mapping, env: Mapping[str, str] | None = None, providers: Mapping[str, Provider] = PROVIDERS, default: str = "primary") -> Settings:
    """Environment before file before defaults; an empty value counts as unset."""
    env = os.environ if env is None else env
    llm, pipeline, keys = (config.get(k, {}) for k in ("llm", "pipeline", "api_keys"))
    name = env.get("LLM_PROVIDER") or llm.get("provider") or default
    if name not in providers:
        raise ValueError(f"Unsupported LLM provider: {name!r} is none of {sorted(providers)}")
    own = providers[name]
    key = env.get("LLM_API_KEY") or env.get(own.key_env) or keys.get(own.key_field, "")
    if not key:
        raise ValueError(f"Missing API key: {name!r} needs one, in the file (api_keys, {own.key_field}) or the environment (LLM_API_KEY, {own.key_env})")
    headers = {h: llm[k] for k, h in (("http_referer", "HTTP-Referer"), ("app_title", "X-Title")) if llm.get(k)}
    return Settings(
        name, own.display_name, env.get("LLM_BASE_URL") or llm.get("base_url") or own.base_url,
        env.get("LLM_MODEL") or llm.get("model") or pipeline.get("model") or own.model,
        llm.get("temperature", pipeline.get("temperature", 1.3)), key, headers or None)
