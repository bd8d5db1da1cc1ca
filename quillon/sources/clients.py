"""Model and search clients, and how a DataFrame calls them.

A client is built once for each Python worker and called batch by batch in
``mapInPandas``. Calls cost time and money, so callers should project and limit
before, and ``operators.lookup.dedup_eval`` calls once for each key. A task that
is retried calls again: write results before they are used twice.
"""

from __future__ import annotations

import hashlib
import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame


class ModelClient(Protocol):
    def ask(self, system: str, user: str, image_url: str | None = None) -> tuple:
        """(answer, prompt tokens, completion tokens[, log-probabilities of the answer's tokens])."""


class SearchClient(Protocol):
    def search(self, query: str, **parameters) -> list[dict]:
        """Raw results."""


class SpacedClient:
    """Keeps calls of one worker ``interval`` seconds apart; bound the workers with ``coalesce``."""

    def __init__(self, inner, interval: float):
        self.inner, self.interval, self.last = inner, interval, 0.0

    def __getattr__(self, name: str):
        call = getattr(self.inner, name)

        def spaced(*args, **kwargs):
            wait = self.last + self.interval - time.monotonic()
            if wait > 0:
                time.sleep(wait)
            self.last = time.monotonic()
            return call(*args, **kwargs)

        return spaced


def with_retry(call: Callable, attempts: int, base: float, factor: float = 2.0, most: float = 30.0, deadline: float | None = None):
    """(result, attempts made); waits as functions.text.backoff says, raises the last error."""
    began = time.monotonic()
    for attempt in range(1, attempts + 1):
        try:
            return call(), attempt
        except Exception:
            wait = min(most, base * factor ** max(0, attempt - 1))
            if attempt == attempts or (deadline is not None and time.monotonic() - began + wait > deadline):
                raise
            time.sleep(wait)


class Limiter:
    """When a worker may call: spacing with jitter, calls in a rolling minute, a daily quota, and waits that a server asks for.

    ``clock`` and ``sleep`` can be replaced in tests. Bound the number of workers
    with ``coalesce``: each has its own limiter.
    """

    def __init__(self, interval: float = 0.0, jitter: float = 0.0, per_minute: int | None = None, daily: int | None = None, seed: int | None = None, clock=time.time, sleep=time.sleep):
        self.interval, self.jitter, self.per_minute, self.daily = max(interval, 60.0 / per_minute if per_minute else 0.0), jitter, per_minute, daily
        self.clock, self.sleep, self.random = clock, sleep, random.Random(seed)
        self.calls: deque[float] = deque()
        self.ready, self.day, self.today, self.closed = 0.0, None, 0, None

    def wait(self) -> float:
        """Seconds until the next call may start; raises where the day's quota is used up."""
        now = self.clock()
        if self.day != int(now // 86400):
            self.day, self.today = int(now // 86400), 0
        if self.closed == self.day or (self.daily is not None and self.today >= self.daily):
            raise RuntimeError("the daily quota of calls is used up")
        while self.calls and self.calls[0] <= now - 60.0:
            self.calls.popleft()
        full = self.per_minute is not None and len(self.calls) >= self.per_minute
        return max(0.0, self.ready - now, self.calls[0] + 60.0 - now if full else 0.0)

    def acquire(self) -> None:
        while (left := self.wait()) > 0:
            self.sleep(min(left, 60.0))
        now = self.clock()
        self.calls.append(now)
        self.today += 1
        self.ready = now + self.interval * (1 + self.random.uniform(-self.jitter, self.jitter))

    def give_back(self) -> None:
        """A call that did not reach the server does not count."""
        if self.calls:
            self.calls.pop()
            self.today -= 1

    def back_off(self, limit: int | None = None, reset_ms: int | None = None) -> None:
        """What a refusal says: a small ``limit`` is one a minute, any other the day's; no call before ``reset_ms`` of the epoch."""
        now = self.clock()
        if limit and 0 < limit <= 30:
            self.per_minute = min(limit, self.per_minute or limit)
            self.interval = max(self.interval, 60.0 / self.per_minute)
        elif limit:
            self.closed = int(now // 86400)  # the next day has its quota again
        self.ready = max(self.ready, reset_ms / 1000.0 if reset_ms else now + (self.interval or 5.0))


class Refused(RuntimeError):
    """A server's answer that there were too many calls, with its limit and the end of the wait, if it tells them."""

    def __init__(self, limit: int | None = None, reset_ms: int | None = None):
        super().__init__("too many calls")
        self.limit, self.reset_ms = limit, reset_ms


class LimitedClient:
    """Calls ``inner`` when ``limiter`` lets it. A call that fails is given back, but one that was refused counts, and the limiter heeds what the server says."""

    def __init__(self, inner, limiter: Limiter):
        self.inner, self.limiter = inner, limiter

    def __getattr__(self, name: str):
        call = getattr(self.inner, name)

        def limited(*args, **kwargs):
            self.limiter.acquire()
            try:
                return call(*args, **kwargs)
            except Refused as refused:
                self.limiter.back_off(refused.limit, refused.reset_ms)
                raise
            except Exception:
                self.limiter.give_back()
                raise

        return limited


def http_json(url: str, headers: dict[str, str], body: dict | None = None, timeout: float = 60.0) -> dict:
    """The JSON that a server answers with; POST if there is a body."""
    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json", "Accept": "application/json"} | headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as error:
        if error.code != 429:
            raise
        told = [error.headers.get(f"X-RateLimit-{n}") for n in ("Limit", "Reset")]
        raise Refused(*[int(v) if v and v.isdigit() else None for v in told]) from error


class ChatClient:
    """A model behind the common chat-completions interface.

    Log-probabilities can be asked for with messages of text only; where an image
    is sent the request goes out without.
    """

    def __init__(self, base_url: str, key: str, model: str, temperature: float = 0.0, logprobs: bool = False, headers: dict[str, str] | None = None, transport=http_json):
        self.url, self.model, self.temperature, self.logprobs, self.transport = f"{base_url.rstrip('/')}/chat/completions", model, temperature, logprobs, transport
        self.headers = {"Authorization": f"Bearer {key}"} | (headers or {})

    def request(self, system: str, user: str, image_url: str | None = None) -> dict:
        content = user if image_url is None else [{"type": "text", "text": user}, {"type": "image_url", "image_url": {"url": image_url}}]
        body = {"model": self.model, "temperature": self.temperature, "messages": [{"role": "system", "content": system}, {"role": "user", "content": content}]}
        return body | ({"logprobs": True} if self.logprobs and image_url is None else {})

    def ask(self, system: str, user: str, image_url: str | None = None) -> tuple:
        found = self.transport(self.url, self.headers, self.request(system, user, image_url))
        choice, usage = found["choices"][0], found.get("usage") or {}
        content = choice["message"]["content"]
        text = content if isinstance(content, str) else "".join(p.get("text", "") for p in content or [])
        tokens = [t["logprob"] for t in (choice.get("logprobs") or {}).get("content") or []]
        return text, int(usage.get("prompt_tokens") or 0), int(usage.get("completion_tokens") or 0), tokens or None


class ContentsClient:
    """A model behind the generate-content interface, where the system text and images are parts of their own."""

    def __init__(self, base_url: str, key: str, model: str, temperature: float = 0.0, transport=http_json):
        self.url, self.headers, self.temperature, self.transport = f"{base_url.rstrip('/')}/models/{model}:generateContent", {"x-goog-api-key": key}, temperature, transport

    def request(self, system: str, user: str, image_url: str | None = None) -> dict:
        parts = [{"text": user}]
        if image_url and image_url.startswith("data:"):
            kind, _, data = image_url[5:].partition(";base64,")
            parts.append({"inline_data": {"mime_type": kind, "data": data}})
        elif image_url:
            parts.append({"file_data": {"file_uri": image_url}})
        return {"system_instruction": {"parts": [{"text": system}]}, "contents": [{"role": "user", "parts": parts}], "generationConfig": {"temperature": self.temperature}}

    def ask(self, system: str, user: str, image_url: str | None = None) -> tuple:
        found = self.transport(self.url, self.headers, self.request(system, user, image_url))
        usage, candidates = found.get("usageMetadata") or {}, found.get("candidates") or [{}]
        text = "".join(p.get("text", "") for p in (candidates[0].get("content") or {}).get("parts") or [])
        return text, int(usage.get("promptTokenCount") or 0), int(usage.get("candidatesTokenCount") or 0), None


#: Which interface a provider has.
PROVIDERS: dict[str, type] = {"openai": ChatClient, "google": ContentsClient, "deepinfra": ChatClient, "openrouter": ChatClient}


def model_client(provider: str, base_url: str, key: str, model: str, **options):
    """The client of a provider; an unknown name raises."""
    if (kind := PROVIDERS.get(provider.strip().lower())) is None:
        raise ValueError(f"unknown provider {provider!r}; known are {', '.join(PROVIDERS)}")
    return kind(base_url, key, model, **options)


#: Parameters that a search by keywords takes.
KEYWORD_PARAMETERS = ("region", "safesearch", "timelimit", "max_results", "page", "backend")
SEARCH_PROVIDERS = ("brave", "duckduckgo")


def search_provider(name: str | None) -> str:
    """A known provider's name; the first for any other."""
    known = (name or "").strip().lower()
    return known if known in SEARCH_PROVIDERS else SEARCH_PROVIDERS[0]


class WebSearch:
    """A search over HTTP with a token in the header; parameters that are None are left out."""

    def __init__(self, url: str, token: str, transport=http_json):
        self.url, self.headers, self.transport = url, {"X-Subscription-Token": token}, transport

    def search(self, query: str, **parameters) -> list[dict]:
        asked = {"q": query} | {k: v for k, v in parameters.items() if v is not None}
        found = self.transport(f"{self.url}?{urllib.parse.urlencode(asked)}", self.headers)
        return [r for r in (found.get("web") or {}).get("results") or [] if isinstance(r, dict)]


class KeywordSearch:
    """A search by a library's function ``text(query, **parameters)``; parameters that it does not know are left out."""

    def __init__(self, text: Callable[..., list[dict]]):
        self.text = text

    def search(self, query: str, **parameters) -> list[dict]:
        return list(self.text(query, **{k: v for k, v in parameters.items() if k in KEYWORD_PARAMETERS and v is not None}))


_ODD = ('{"aligned": "true", "ai_generated": "false", "confidence": 0.9}', '{"aligned": "partial", "confidence": 0.5}', '{"aligned": "no", "ai_generated": "likely", "confidence": 0.8}')
_LABELS = ("Misinformation", "Not Misinformation", "Uncertain")


class EchoModel:
    """Offline stand-in: answers follow from the MD5 of what it is asked and shown, in the form that the prompt wants."""

    def ask(self, system: str, user: str, image_url: str | None = None) -> tuple[str, int, int]:
        shown = "" if image_url is None else f"\n{image_url}"
        h = hashlib.md5(f"{system}\n{user}{shown}".encode()).hexdigest()
        n = int(h[:8], 16)
        if "JSON array of strings" in user:
            answer = json.dumps([f"{h[:6]} who?", f"{h[6:12]} when?", f"{h[12:18]} where?", f"{h[:6]} WHO?"])
        elif "with answer, confidence" in user:
            answer = json.dumps({"answer": f"about {h[:6]}", "confidence": n % 101 / 100, "citations": [{"url": f"u/{h[:4]}", "title": "t"}]})
        elif "with index and reason" in user:
            answer = json.dumps({"index": n % 3 + 1, "reason": h[:6]})
        elif "Finish[" in user:
            kind = ("TEXT", "IMAGE", "")["Finish[TEXT" not in user if "Finish[MATCH]" not in user else 2]
            answer = (f"Observation: {h[:6]} Action: Finish[{kind} SUPPORTS]", f"so Finish[{kind} REFUTES]", "?")[n % 3] if kind else ("Finish[MATCH]", "Finish[MISMATCH]", "?")[n % 3]
        elif "with label, confidence" in system:
            answer = json.dumps({"label": _LABELS[n % 3], "confidence": n % 101 / 100, "rationale": h[:6], "key_factors": [h[6:12]]})
        else:
            answer = f"Answer: {_ODD[n % 3]}"
        return answer, len(user.split()), len(answer.split())


_clients: dict[Callable, object] = {}


def _client(factory: Callable):
    if factory not in _clients:
        _clients[factory] = factory()
    return _clients[factory]


def ask_model(df: DataFrame, factory: Callable[[], ModelClient], system: str, user: str, out: str, image: str | None = None) -> DataFrame:
    """``df`` with columns ``out``_raw, _prompt, _completion, _error and _logprobs. A call that fails gives an error, not a failed task.

    ``image`` names the column of an image's url that goes with the question.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    names = [f"{out}_{n}" for n in ("raw", "prompt", "completion", "error", "logprobs")]
    at, seen = df.columns.index(user), None if image is None else df.columns.index(image)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        client = _client(factory)
        for batch in batches:
            rows = []
            images = [None] * batch.num_rows if seen is None else batch.column(seen).to_pylist()
            for question, url in zip(batch.column(at).to_pylist(), images, strict=True):
                try:
                    raw, prompt, completion, *more = client.ask(system, question or "", url)
                    rows.append((raw, prompt, completion, None, more[0] if more else None))
                except Exception as error:
                    rows.append((None, 0, 0, str(error), None))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()))
            added = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else ((),) * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, f"{schema}, {names[0]} string, {names[1]} long, {names[2]} long, {names[3]} string, {names[4]} array<double>")


class EchoSearch:
    """Offline stand-in: results that follow from the MD5 of the query, one of them without a description."""

    def search(self, query: str, **parameters) -> list[dict]:
        h = hashlib.md5(query.encode()).hexdigest()
        return [
            {"title": f"t{h[:4]}", "url": f"http://a/{h[:8]}", "description": f"d {h[8:12]}", "meta_url": {"host": "a"}},
            {"title": "none", "url": "http://b", "description": ""},
            {"title": "", "href": f"http://c/{h[:2]}", "body": h[12:20], "source": "c"},
        ][: parameters.get("max_results") or 3]


def search_web(df: DataFrame, factory: Callable[[], SearchClient], query: str, out: str, **parameters) -> DataFrame:
    """``df`` with ``out``, an array of title, url, description and source, and ``out``_error; results without a url go."""
    kind = "array<struct<title: string, url: string, description: string, source: string>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = df.columns.index(query)

    def text(row: dict, *names: str) -> str:
        return next((t for n in names if (t := str(row.get(n) or "").strip())), "")

    def plain(row: dict) -> dict:
        host = row["meta_url"].get("host") if isinstance(row.get("meta_url"), dict) else None
        return {"title": text(row, "title"), "url": text(row, "url", "href"), "description": text(row, "description", "snippet", "body"), "source": text(row | {"_host": host}, "source", "_host")}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        client = _client(factory)
        fields = pa.list_(pa.struct([(n, pa.string()) for n in ("title", "url", "description", "source")]))
        for batch in batches:
            found, errors = [], []
            for q in batch.column(at).to_pylist():
                try:
                    found.append([r for r in map(plain, client.search(q or "", **parameters)) if r["url"]])
                    errors.append(None)
                except Exception as error:
                    found.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, fields), pa.array(errors, pa.string())], names=[*batch.schema.names, out, f"{out}_error"])

    return df.mapInArrow(run, f"{schema}, {out} {kind}, {out}_error string")
