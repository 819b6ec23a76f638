"""Text of chat requests, responses and stream events from their JSON bodies.

Bodies are parsed to variants; a value counts as text only if it is a JSON string, so numbers
and booleans are not turned into text.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class ProviderAdapter(Protocol):
    """Columns of extracted text for one provider's bodies."""

    def request_text(self, body: Column) -> Column: ...

    def response_text(self, body: Column) -> Column: ...

    def delta_text(self, body: Column) -> Column: ...


def _string(v: Column, path: str = "$") -> Column:
    """The value at ``path`` if it is a JSON string, else null."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, path, "string"))


def content_text(v: Column, path: str) -> Column:
    """A string as it is; the text parts of an array joined, null if they are empty."""
    at = F.try_variant_get(v, path, "variant")
    parts = F.try_variant_get(v, path, "array<variant>")
    texts = F.transform(parts, lambda p: F.when(_string(p, "$.type") == "text", _string(p, "$.text")))
    joined = F.nullif(F.array_join(texts, ""), F.lit(""))
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, path, "string")).when(parts.isNotNull(), joined)


class ChatAdapter:
    """Chat completions and response events."""

    def request_text(self, body: Column) -> Column:
        """Contents of the user's messages, one per line; null if there is nothing."""
        messages = F.try_variant_get(F.try_parse_json(body), "$.messages", "array<variant>")
        texts = F.transform(messages, lambda m: F.when(_string(m, "$.role") == "user", content_text(m, "$.content")))
        return F.nullif(F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n"), F.lit(""))

    def response_text(self, body: Column) -> Column:
        return content_text(F.try_parse_json(body), "$.choices[0].message.content")

    def delta_text(self, body: Column) -> Column:
        """An event of the response kind gives its delta or nothing, never a choice."""
        v = F.try_parse_json(body)
        event = F.coalesce(_string(v, "$.type") == "response.output_text.delta", F.lit(False))
        return F.when(event, _string(v, "$.delta")).otherwise(_string(v, "$.choices[0].delta.content"))


def skip_list(configured: list[str], header: Column) -> Column:
    """Configured names, then those of a comma-separated header, trimmed; no dedup, and an
    empty header gives one empty name."""
    given = F.transform(F.split(header, ",", -1), lambda x: F.trim(x))
    fixed = F.array(*map(F.lit, configured)) if configured else F.array().cast("array<string>")
    return F.concat(fixed, F.coalesce(given, F.array().cast("array<string>")))


def forwarded_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, v: F.lower(k) != "host")


def proxy_route(path: Column) -> Column:
    """Status of the health path; null for what is forwarded."""
    return F.when(path == "/health", F.lit(200))


def metrics_route(method: Column, path: Column) -> Column:
    return F.when((method == "GET") & (path == "/metrics"), F.lit(200)).otherwise(F.lit(404))
