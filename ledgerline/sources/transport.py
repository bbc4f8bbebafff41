"""A chat-completions endpoint as a transport of the model loop."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request

from ..operators.model import Refused, Transport


def http(url: str, model: str, key_env: str | None = None, timeout: float = 120.0) -> Transport:
    """prompt -> envelope by one POST; a status other than 2xx is http-N, a body that is not JSON is schema. ValueError if something is not set."""
    if not url.startswith(("http://", "https://")) or not model.strip():
        raise ValueError("an http(s) url and a model are needed")
    if key_env and not os.environ.get(key_env):
        raise ValueError(f"the variable {key_env} is not set")

    def send(prompt: str) -> dict:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {os.environ[key_env]}"} if key_env else {})
        body = json.dumps({"model": model, "messages": [{"role": "user", "content": prompt}]}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, head), timeout=timeout) as f:
                return json.loads(f.read())
        except urllib.error.HTTPError as e:
            raise Refused(f"http-{e.code}") from None
        except urllib.error.URLError as e:
            if isinstance(e.reason, TimeoutError):
                raise TimeoutError from None
            raise
        except ValueError:
            raise Refused("schema") from None

    return send
