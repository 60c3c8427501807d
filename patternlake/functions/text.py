"""Pattern strings, replies and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REPLY = "struct<diagnosis:string,cited_patterns:array<string>,reason:string>"
ERROR = "__ERROR__"


def pattern_text(items: Column, by: str = " & ") -> Column:
    return F.array_join(F.array_sort(items), by)


def pattern_items(text: Column, by: str = " & ") -> Column:
    """The items of a pattern string, sorted."""
    return F.array_sort(F.split(text, by.replace("&", "[&]")))


def is_error(reply: Column) -> Column:
    return reply.startswith(ERROR)


def parse_reply(reply: Column) -> Column:
    """The JSON object in a reply: from its first brace to its last, null where that is no object with a diagnosis."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, REPLY)
    return F.when((body != "") & parsed["diagnosis"].isNotNull(), parsed)


def normal_diagnosis(diagnosis: Column) -> Column:
    return F.lower(F.trim(diagnosis))


def fixed(x: Column, digits: int) -> Column:
    """``x`` with that many decimals, rounded by its binary value as C's printf does; ``format_string`` rounds its shortest decimal form, which differs where that ends in 5."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits))


def format_lift(lift: Column) -> Column:
    """Two decimals; very large and infinite lifts as words."""
    return F.when(lift > 1e4, "only in anomalous windows").otherwise(F.format_string("%.2f", lift))


def render_prompt(context: Column, window: Column, library: Column | None = None) -> Column:
    """A diagnosis prompt: context, the window's items and, if given, the library (array of struct pattern, sup_anom, lift)."""
    parts = [context, F.concat(F.lit("Observed states: "), F.array_join(window, ", "))]
    if library is not None:
        lines = F.transform(library, lambda r: F.format_string("- %s (support in anomalous windows %.3f, lift %s)", r["pattern"], r["sup_anom"], format_lift(r["lift"])))
        parts.append(F.concat(F.lit("Known patterns:\n"), F.array_join(lines, "\n")))
    parts.append(F.lit('Answer with JSON: {"diagnosis": "normal or anomalous", "cited_patterns": [], "reason": ""}'))
    return F.concat_ws("\n", *parts)
