"""Settings of a process: verbosity, contact address, service addresses and limits."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass
class Settings:
    verbose: bool = True
    email: str | None = None
    osf_api: str = "https://api.osf.io/v2"
    osf_delay: float = 0.0
    osf_calls: int = 0
    chat_url: str = "https://api.groq.com/openai/v1"
    chat_model: str = "llama-3.3-70b-versatile"
    chat_max_calls: int = 30
    chat_use: bool = False


settings = Settings()


def verbose(value: bool | None = None) -> bool:
    """Gets or sets whether messages are shown."""
    if value is not None:
        if value not in (True, False):
            raise ValueError("set verbose with True or False")
        settings.verbose = bool(value)
    return settings.verbose


def email(address: str | None = None) -> str | None:
    """Gets or sets the address that polite services ask for."""
    if address is not None:
        if not isinstance(address, str) or not re.search(r".+@.+\..+$", address):
            raise ValueError("Set email with a valid email address")
        settings.email = address
    return settings.email


def message(text: str) -> None:
    if settings.verbose:
        print(text)
