"""Chat templates: prompts, supervised segments, and the parser of old transcripts. Messages are arrays of (role, content)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import BOS, EOS, STRIPPED, char_count, strip
from tessera.functions.tokenizers import CHAR, Tokenizer
from tessera.functions.ids import IGNORED


@dataclass(frozen=True)
class Template:
    version: str
    prefix: str = BOS
    end: str = EOS
    #: What comes before a role's content.
    roles: dict[str, str] = field(default_factory=lambda: {"system": "System: ", "user": "\n\nUser: ", "assistant": "\n\nAssistant: ", "observation": "\n\nObservation: "})

    def label(self, role: Column) -> Column:
        return F.create_map(*[F.lit(x) for pair in self.roles.items() for x in pair])[role]


#: Fixed value: the version that records of samples carry.
TEMPLATES = {t.version: t for t in (Template("lpt-ds-v1"),)}
DEFAULT = "lpt-ds-v1"


def prompt(messages: Column, version: str = DEFAULT, ask: bool = False) -> Column:
    """The whole text; an end after each assistant message, and an open assistant turn if ``ask``."""
    t = TEMPLATES[version]
    parts = F.transform(messages, lambda m: F.concat(t.label(m["role"]), m["content"], F.when(m["role"] == "assistant", t.end).otherwise("")))
    return F.concat(F.lit(t.prefix), F.array_join(parts, ""), F.lit(t.roles["assistant"] if ask else ""))


def segments(messages: Column, version: str = DEFAULT) -> Column:
    """(text, supervise): what the assistant says, and its ends, are supervised. Null without an assistant message."""
    t = TEMPLATES[version]
    part = lambda text, on: F.struct(text.alias("text"), on.alias("supervise"))

    def of(m: Column) -> Column:
        own = m["role"] == "assistant"
        both = F.array(part(t.label(m["role"]), F.lit(False)), part(m["content"], own))
        return F.when(own, F.concat(both, F.array(part(F.lit(t.end), F.lit(True))))).otherwise(both)

    whole = F.concat(F.array(part(F.lit(t.prefix), F.lit(False))), F.flatten(F.transform(messages, of)))
    return F.when(F.exists(messages, lambda m: m["role"] == "assistant"), whole)


def text_segments(text: Column, version: str = DEFAULT) -> Column:
    """A text and its end, both supervised, without a prefix."""
    part = lambda x: F.struct(x.alias("text"), F.lit(True).alias("supervise"))
    return F.array(part(text), part(F.lit(TEMPLATES[version].end)))


def encoded(parts: Column, most: int | None = None, tokenizer: Tokenizer = CHAR) -> Column:
    """(input_ids, labels) of segments, each tokenized by itself, up to ``most``; empty segments have no ids."""
    own = tokenizer.segments(F.transform(parts, lambda s: s["text"]))
    ids = F.flatten(own)
    labels = F.flatten(F.zip_with(parts, own, lambda s, x: F.when(s["supervise"], x).otherwise(F.array_repeat(F.lit(IGNORED), F.size(x)))))
    cut = (lambda a: F.slice(a, 1, most)) if most else (lambda a: a)
    return F.struct(cut(ids).alias("input_ids"), cut(labels).alias("labels"))


def too_short(input_ids: Column) -> Column:
    """An error for samples that predict nothing: fewer than two tokens."""
    return F.when(F.size(input_ids) < 2, "too_few_tokens")


def token_counts(parts: Column) -> Column:
    """(tokens, supervised) of segments, without making the ids; the first token can't be supervised."""
    count = lambda p: F.aggregate(F.transform(p, lambda s: char_count(s["text"])), F.lit(0), lambda a, x: a + x)
    on = count(F.filter(parts, lambda s: s["supervise"]))
    return F.struct(count(parts).alias("tokens"), (on - F.when(parts[0]["supervise"] & (char_count(parts[0]["text"]) > 0), 1).otherwise(0)).alias("supervised"))


#: Fixed value: labels of old transcripts, and the end.
LABELS = f"(System|User|Assistant|Observation):{STRIPPED}*|{EOS}"


def parse_transcript(text: Column) -> Column:
    """Messages of an old transcript: text between a label and the next label or end; what follows an end, or comes before the
    first label, doesn't count. Labels split contents as well."""
    marks = F.regexp_extract_all(text, F.lit(f"({LABELS})"), 1)
    between = F.split(text, LABELS, -1)
    roles = F.transform(marks, lambda m: F.when(m == EOS, F.lit(None)).otherwise(F.lower(F.regexp_extract(m, r"\A(\w+):", 1))))
    own = F.transform(roles, lambda r, i: F.struct(r.alias("role"), strip(F.get(between, i + 1)).alias("content")))
    return F.filter(own, lambda m: m["role"].isNotNull())


def transcript_error(messages: Column) -> Column:
    return (
        F.when(F.exists(messages, lambda m: m["content"] == ""), "content_blank")
        .when(F.size(messages) == 0, "messages_empty")
        .when(F.get(messages, F.lit(0))["role"] != "user", "user_not_first")
    )


def instruction(ask: Column, context: Column, reply: Column) -> Column:
    """Messages of an instruction with an optional context and its response; null without a response, fails without an instruction."""
    ask, context, reply = (F.coalesce(strip(c), F.lit("")) for c in (ask, context, reply))
    ask = F.when(ask == "", F.raise_error(F.lit("blank instruction")).cast("string")).otherwise(ask)
    # fixed value: what comes between an instruction and its context
    user = F.when(context != "", F.concat(ask, F.lit("\n\n补充上下文：\n"), context)).otherwise(ask)
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.when(reply != "", F.array(message("user", user), message("assistant", reply)))


def titled_text(body: Column, title: Column) -> Column:
    """A body under its title, or the one that there is, or nothing."""
    body, title = (F.coalesce(strip(c), F.lit("")) for c in (body, title))
    # fixed values: labels of title and body
    both = F.concat(F.lit("标题："), title, F.lit("\n\n正文：\n"), body)
    return F.when((body != "") & (title != ""), both).when(body != "", body).otherwise(title)
