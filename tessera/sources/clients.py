"""Interfaces to outside services: a picture model, a judge and a video encoder, each with an offline stand-in."""

from __future__ import annotations

import base64
import json
import shutil
import time
from collections.abc import Callable
from typing import Any

from tessera.sources.images import mime

#: Waits in seconds before each attempt, and the answers that are worth another.
WAITS, AGAIN = (0, 3, 8, 15), {429, 500, 502, 503, 504}
MOST_TOKENS = 65536
#: fetch(url, body) -> (status, answer)
Fetch = Callable[[str, dict], tuple[int, Any]]


class ServiceError(RuntimeError):
    pass


def call(fetch: Fetch, url: str, body: dict, wait: Callable[[float], None] = time.sleep) -> Any:
    """An answer, tried again after answers that pass; any other refusal is an error with the service's words."""
    status = None
    for seconds in WAITS:
        if seconds:
            wait(seconds)
        status, answer = fetch(url, body)
        if status in AGAIN:
            continue
        if status >= 400:
            raise ServiceError(f"HTTP {status}: {answer.get('error', {}).get('message', '') if isinstance(answer, dict) else ''}")
        return answer
    raise ServiceError(f"HTTP {status} after {len(WAITS)} attempts")


def image_part(content: bytes) -> dict:
    """A picture in a request, its type by its bytes."""
    kind = mime(content)
    if not kind:
        raise ValueError("not a PNG, JPEG, WebP or GIF")
    return {"inlineData": {"mimeType": kind, "data": base64.b64encode(content).decode()}}


def usage(answer: dict) -> dict:
    """Token counts of an answer, those of pictures apart."""
    u = answer.get("usageMetadata", {})
    image = sum(d.get("tokenCount", 0) for d in u.get("candidatesTokensDetails", []) if d.get("modality") == "IMAGE")
    return {"prompt": u.get("promptTokenCount", 0), "candidates": u.get("candidatesTokenCount", 0), "image": image, "thoughts": u.get("thoughtsTokenCount", 0), "cached": u.get("cachedContentTokenCount", 0)}


class ImageClient:
    """Asks for pictures; each call is a ledger record. A refusal to paint is a record too, not an error."""

    def __init__(self, fetch: Fetch, url: str, cost: Callable[[dict], float | None], estimate: float = 0.0, budget: float | None = None, wait: Callable[[float], None] = time.sleep):
        self.fetch, self.url, self.cost, self.estimate, self.budget, self.wait = fetch, url, cost, estimate, budget, wait
        self.records: list[dict] = []

    def spent(self) -> float:
        return sum(r["cost"] or 0.0 for r in self.records)

    def generate(self, prompt: str, references: list[bytes] = (), turns: list[dict] = ()) -> dict:
        if self.budget is not None and self.spent() + self.estimate > self.budget + 1e-9:
            raise ServiceError(f"the next picture would pass the budget of {self.budget}")
        turn = {"role": "user", "parts": [*map(image_part, references), {"text": prompt}]}
        began = time.monotonic()
        answer = call(self.fetch, self.url, {"contents": [*turns, turn]}, self.wait)
        content = next(iter(answer.get("candidates", [])), {}).get("content", {})
        data = next((p["inlineData"]["data"] for p in content.get("parts", []) if "inlineData" in p), None)
        used = usage(answer)
        self.records.append({**used, "cost": self.cost(used), "ok": data is not None, "blocked": data is None, "seconds": time.monotonic() - began})
        return {"image": base64.b64decode(data) if data else None, "turns": [*turns, turn, content] if data else list(turns), "record": self.records[-1]}


class JudgeClient:
    """Asks for an answer in a schema; an answer cut off for length is asked for again with twice the room."""

    def __init__(self, fetch: Fetch, url: str, wait: Callable[[float], None] = time.sleep):
        self.fetch, self.url, self.wait = fetch, url, wait

    def ask(self, prompt: str, schema: dict, images: list[bytes] = (), tokens: int = 4096) -> dict:
        while True:
            body = {"contents": [{"role": "user", "parts": [*map(image_part, images), {"text": prompt}]}], "generationConfig": {"responseSchema": schema, "maxOutputTokens": tokens}}
            c = next(iter(call(self.fetch, self.url, body, self.wait).get("candidates", [])), {})
            if c.get("finishReason") == "MAX_TOKENS" and tokens < MOST_TOKENS:
                tokens = min(MOST_TOKENS, 2 * tokens)
                continue
            try:
                return json.loads("".join(p.get("text", "") for p in c.get("content", {}).get("parts", [])))
            except ValueError as e:
                raise ServiceError("the judge's answer is not JSON") from e


def image_models(answer: dict) -> list[str]:
    """Of a catalogue's answer, the models that make content and whose name says image."""
    return [m["name"].removeprefix("models/") for m in answer.get("models", []) if "generateContent" in m.get("supportedGenerationMethods", []) and "image" in m["name"]]


def offline(picture: bytes) -> Fetch:
    """A stand-in that always paints the same picture."""
    part = {"inlineData": {"mimeType": mime(picture), "data": base64.b64encode(picture).decode()}}
    return lambda url, body: (200, {"candidates": [{"content": {"role": "model", "parts": [part]}}], "usageMetadata": {"promptTokenCount": 42, "candidatesTokenCount": 1120, "candidatesTokensDetails": [{"modality": "IMAGE", "tokenCount": 1120}]}})


def find_encoder(name: str = "ffmpeg") -> str | None:
    """The video encoder's path; without one, videos are left out with a note."""
    return shutil.which(name)
