"""Chat messages and their rendering to text."""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmill import fixed_values as fx


@dataclass(frozen=True)
class ChatTemplate:
    """Markers of a model's chat format.

    ``header`` holds ``{role}``. The header must end on a token boundary, so that
    the tokens of a prompt are a prefix of the tokens of prompt plus answer.
    """

    header: str = "<|{role}|>\n"
    end_of_turn: str = "\n<|end|>\n"

    def header_for(self, role: Column) -> Column:
        before, after = self.header.split("{role}")
        return F.concat(F.lit(before), role, F.lit(after))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(
    abstract: Column, summary: Column | None = None, system_prompt: str = fx.SYSTEM_PROMPT
) -> Column:
    """``array<struct<role, content>>``: system, user and, where there is a summary, assistant."""
    asked = F.concat(F.lit(fx.USER_PROMPT_BEFORE), abstract, F.lit(fx.USER_PROMPT_AFTER))
    prompt = F.array(_message("system", F.lit(system_prompt)), _message("user", asked))
    if summary is None:
        return prompt
    answer = F.array(_message("assistant", summary))
    return F.when(summary.isNull(), prompt).otherwise(F.concat(prompt, answer))


def render_chat(
    messages: Column, template: ChatTemplate = ChatTemplate(), add_generation_header: Column | bool = False
) -> Column:
    """Messages as one text; with the header of the coming answer where asked for."""
    turns = F.transform(
        messages,
        lambda m: F.concat(template.header_for(m["role"]), m["content"], F.lit(template.end_of_turn)),
    )
    text = F.array_join(turns, "")
    if add_generation_header is False:
        return text
    opened = F.concat(text, template.header_for(F.lit("assistant")))
    if add_generation_header is True:
        return opened
    return F.when(add_generation_header, opened).otherwise(text)


def render_example(abstract: Column, summary: Column | None = None, template: ChatTemplate = ChatTemplate()) -> Column:
    """Rendered prompt, answered where ``summary`` is not null and left open otherwise."""
    unanswered = True if summary is None else summary.isNull()
    return render_chat(chat_messages(abstract, summary), template, unanswered)
