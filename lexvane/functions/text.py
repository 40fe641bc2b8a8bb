"""Text functions: rendering, tagged extraction, clean-up of explanations, keys and labels. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Default tokens: the parts between single spaces."""
    return F.split(text, " ")


def truncate_tokens(tok: Column, n: int) -> Column:
    """The first n tokens."""
    return F.slice(tok, 1, n)


def prefix_text(tok: Column, pos: Column, special: list[str] | None = None) -> Column:
    """Text of the tokens up to 0-based position pos, pos included; special tokens are skipped."""
    part = F.slice(tok, 1, pos + 1)
    return F.array_join(F.filter(part, lambda t: ~t.isin(special)) if special else part, " ")


def token_count(text: Column) -> Column:
    """Number of tokens(text), without making them."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def leading_text(text: Column, pos: Column) -> Column:
    """prefix_text(tokens(text), pos), without making the tokens."""
    return F.call_function("substring_index", text, F.lit(" "), (pos + 1).cast("int"))


def split_template(template: str, name: str) -> tuple[str, str]:
    """What stands before and after the placeholder {name}; without it, an error."""
    before, mark, after = template.partition("{" + name + "}")
    if not mark:
        raise ValueError(f"the template has no placeholder {{{name}}}")
    return before, after


def render(template: str, name: str, value: Column) -> Column:
    """template with value at its placeholder; value is not scanned again."""
    before, after = split_template(template, name)
    return F.concat(F.lit(before), value, F.lit(after))


def unwrap(text: Column, template: str, name: str) -> Column:
    """What render() put in; null where text doesn't fit the template."""
    before, after = split_template(template, name)
    fits = text.startswith(before) & text.endswith(after) & (F.length(text) >= len(before) + len(after))
    return F.when(fits, F.substring(text, F.lit(len(before) + 1), F.length(text) - len(before) - len(after)))


def user_prompt(content: Column) -> Column:
    """A conversation of one user turn."""
    return F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))


def append_turn(prompt: Column, response: Column, role: str = "assistant") -> Column:
    return F.concat(prompt, F.array(F.struct(F.lit(role).alias("role"), response.alias("content"))))


def substitute_marker(prompt: Column, placeholder: str, marker: str) -> Column:
    """prompt with the placeholder replaced in every message; null if no message holds it."""
    held = F.exists(prompt, lambda m: F.contains(m["content"], F.lit(placeholder)))
    return F.when(held, F.transform(prompt, lambda m: F.struct(m["role"].alias("role"), F.replace(m["content"], F.lit(placeholder), F.lit(marker)).alias("content"))))


def wrap_tag(text: Column, tag: str) -> Column:
    return F.concat(F.lit(f"<{tag}>\n"), text, F.lit(f"\n</{tag}>"))


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def extract_tag(text: Column, tag: str, on_miss: str = "null") -> Column:
    """The first, shortest body of a tag, across lines, trimmed. on_miss: null, or raw for the whole text, trimmed."""
    pattern = f"(?s)<{tag}>(.*?)</{tag}>"
    found = F.when(F.regexp_like(text, F.lit(pattern)), _trim(F.regexp_extract(text, pattern, 1)))
    if on_miss == "raw":
        return F.coalesce(found, _trim(text))
    if on_miss != "null":
        raise ValueError(f"on_miss is null or raw, not {on_miss}")
    return found


#: One list mark at the start of a line (bullet, 1. 1), (1), a. a), (a), roman numeral), and a leading bold run.
LIST_MARK = r"(?U)^\s*(?:[-*•+–—]|\d+[.)]|\(\d+\)|[a-zA-Z][.)]|\([a-zA-Z]\)|[ivxIVX]+[.)])\s+"
BOLD_RUN = r"(?U)^\*\*(.+?)\*\*\s*"


def clean_explanation(raw: Column, tag: str = "analysis") -> Column:
    """Body of the tag, one feature a line, joined by blank lines; null without both tags.

    Of each line goes one list mark; a leading bold run is unwrapped and a space put after it; the line is trimmed and loses
    * and _ at both ends; empty lines go.
    """

    def clean(line: Column) -> Column:
        line = F.regexp_replace(F.regexp_replace(line, LIST_MARK, ""), BOLD_RUN, "$1 ")
        return F.regexp_replace(_trim(line), r"^[*_]+|[*_]+$", "")

    return F.array_join(F.filter(F.transform(F.split(extract_tag(raw, tag), "\n"), clean), lambda x: x != ""), "\n\n")


def feature_count(explanation: Column) -> Column:
    """Paragraphs, parted by blank lines."""
    return F.size(F.split(explanation, "\n\n"))


def min_features(explanation: Column, n: int = 2) -> Column:
    return feature_count(explanation) >= n


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def source_label(doc_id: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """Label of the first rule whose substring is in doc_id."""
    out = F.lit(other)
    for part, label in reversed(rules):
        out = F.when(F.contains(doc_id, F.lit(part)), F.lit(label)).otherwise(out)
    return out


def display_text(text: Column, n: int) -> Column:
    """The first n characters, and how many more there are."""
    more = F.length(text) - n
    return F.when(more > 0, F.concat(F.left(text, F.lit(n)), F.lit("... ["), more.cast("string"), F.lit(" more chars]"))).otherwise(text)
