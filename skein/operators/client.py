"""The model behind an OpenAI-compatible chat endpoint, asked from the driver."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from .answers import ModelError, hidden

# Names of the settings, which the environment or a file .env gives.
KEY, URL, MODEL = "LLM_API_KEY", "LLM_BASE_URL", "LLM_MODEL"
TIMEOUT, FAULT_BYTES = 60.0, 16 << 10


def settings(folder: str = ".", environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """The environment, and what the nearest .env at or above the folder adds to it."""
    known = dict(os.environ if environment is None else environment)
    here = Path(folder).resolve()
    found = next((p / ".env" for p in (here, *here.parents) if (p / ".env").is_file()), None)
    for line in found.read_text(encoding="utf-8-sig").splitlines() if found else ():
        name, is_set, value = line.strip().removeprefix("export ").partition("=")
        if is_set and not name.startswith("#"):
            known.setdefault(name.strip(), value.strip().strip("\"'"))
    return known


@dataclass(frozen=True)
class HttpClient:
    """Called with messages and a temperature; gives the reply's payload. Whatever fails is a ModelError without secrets."""

    key: str
    url: str
    model: str
    timeout: float = TIMEOUT

    def __post_init__(self):
        for name, value in ((KEY, self.key), (URL, self.url), (MODEL, self.model)):
            if not value:
                raise ModelError(f"{name} is not set")
        if not self.url.startswith(("http://", "https://")):
            raise ModelError(f"{URL} must be an http or https address")
        if self.timeout <= 0:
            raise ModelError("the timeout must be positive")

    @classmethod
    def from_settings(cls, known: Mapping[str, str], **options) -> HttpClient:
        return cls(*(known.get(n, "").strip() for n in (KEY, URL, MODEL)), **options)

    def __call__(self, messages: list[dict[str, str]], temperature: float) -> dict:
        body = json.dumps({"model": self.model, "messages": messages, "temperature": temperature}, ensure_ascii=False).encode()
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", body, headers), timeout=self.timeout) as reply:
                payload = json.loads(reply.read())
        except urllib.error.HTTPError as e:
            raise ModelError(self.clean(f"the model's server said {e.code}: {e.read(FAULT_BYTES).decode('utf-8', 'replace')}")) from None
        except TimeoutError:
            raise ModelError(f"no reply within {self.timeout:g} seconds") from None
        except (OSError, ValueError) as e:
            raise ModelError(self.clean(f"the model could not be asked: {e}")) from None
        if not isinstance(payload, dict):
            raise ModelError("the reply is no JSON object")
        return payload

    def clean(self, text: str) -> str:
        return hidden(text, self.key, self.url)
