"""Prompt text, context sections, chat rendering and answer clean-up
(F14-F18, F21, F22) as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (formats consumers rely on)
# ---------------------------------------------------------------------------
# context section header: source name, chunk ordinal, score to 3 decimals
SECTION_FORMAT = "[Source: %s | Chunk %s | Relevance: %s]\n%s"
SECTION_SEPARATOR = "\n\n"
# chat transcript tags: "<|role|>" newline content "</s>", a final assistant tag
CHAT_ROLES = ("system", "user", "assistant")
CHAT_END = "</s>"
ASSISTANT_TAG = "<|assistant|>"
# generation output is cut at the first occurrence of this marker
ANSWER_CUT = "\n\n---"
# defaults for missing metadata
MISSING_SOURCE = "unknown"
MISSING_CHUNK = "?"
# ---------------------------------------------------------------------------

SYSTEM_PROMPT = (
    "The user message holds numbered passages from an index and one question. "
    "Treat the passages as your only evidence. Name the source of each fact you "
    "use. If the passages disagree or leave the question open, say which part "
    "stays open. Two or three sentences are enough."
)
NO_CONTEXT_SYSTEM_PROMPT = "No passages are attached to this question. Reply with what you know for certain."
NO_CONTEXT_ANSWER = "Without passages there is nothing to base a reply on."
NO_HIT_ANSWER = "The index holds no passage close enough to this question."


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def score3(x) -> Column:
    """Score with 3 decimals; rounded first so the text does not depend on
    the formatting library's tie rule."""
    return F.format_number(F.round(_c(x).cast("double"), 3), 3)


def section(filename, chunk_index, score, text) -> Column:
    """one context section."""
    return F.format_string(
        SECTION_FORMAT,
        F.coalesce(_c(filename), F.lit(MISSING_SOURCE)),
        F.coalesce(_c(chunk_index).cast("string"), F.lit(MISSING_CHUNK)),
        F.regexp_replace(score3(score), ",", ""),
        F.coalesce(_c(text), F.lit("")))


QUESTION_HEAD = "Question\n"
PASSAGES_HEAD = "\n\nPassages\n"


def user_message(context_block, question) -> Column:
    """F16: user turn = the question, then the passages."""
    return F.concat(F.lit(QUESTION_HEAD), _c(question), F.lit(PASSAGES_HEAD), F.coalesce(_c(context_block), F.lit("")))


def messages(context_block, question) -> Column:
    """F16: ``array<struct<role, content>>`` of system + user messages."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), user_message(context_block, question).alias("content")))


def no_context_messages(question) -> Column:
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(NO_CONTEXT_SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), _c(question).alias("content")))


def chat_segment(role, content) -> Column:
    """One rendered message, NULL for roles outside system/user/assistant."""
    r = _c(role)
    return F.when(r.isin(*CHAT_ROLES),
                  F.concat(F.lit("<|"), r, F.lit("|>\n"), F.coalesce(_c(content), F.lit("")),
                           F.lit(CHAT_END)))


def render_chat(msgs) -> Column:
    """F17 on a message array: segments joined by newlines + assistant tag."""
    segs = F.filter(F.transform(_c(msgs), lambda m: chat_segment(m["role"], m["content"])),
                    lambda s: s.isNotNull())
    return F.concat(F.array_join(F.concat(segs, F.array(F.lit(ASSISTANT_TAG))), "\n"))


def postprocess_answer(generated, prompt) -> Column:
    """drop an echoed prompt, cut at the first ``\\n\\n---``, strip."""
    from .text import strip
    g, p = _c(generated), _c(prompt)
    body = F.when(g.startswith(p), g.substr(F.length(p) + 1, F.length(g))).otherwise(g)
    return strip(F.substring_index(strip(body), ANSWER_CUT, 1))
