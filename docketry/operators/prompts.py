"""Prompts: families of templates with their variants, rendered by literal replacement; few-shot examples; token cost.

A family is a question put to a model about a case: its importance from the case's name alone or from its text, whether it
is hard, whether a judgment or a decision is due, which formation of judges sits, which keywords fit, or a summary. The
wording is a parameter (``FAMILIES`` has ours); what a family holds, and when, is fixed here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a text selector shows, as the prompt says it.
SHOWN = {1: "the subject matter of the case", 2: "the questions put to the parties", 3: "the subject matter of the case and the questions put to the parties", 4: "a summary of the case"}
UNSURE = "If you cannot tell, say that you do not have enough information."
LEVELS = (
    "key_case: among the most important, chosen for the official reports; 1: high importance, develops or changes the case law; "
    "2: medium importance, goes beyond applying the case law; 3: low importance, applies the case law."
)
HARDNESS = "Easy: applies existing case law or goes little beyond it; Hard: develops, clarifies or changes the case law."
COURTS = "Judgment: decides the merits; Decision: mostly on whether the case is admissible."
FORMATIONS = {True: "Committee: settled case law; Chamber: most cases; Grand Chamber: grave questions of interpretation.", False: "Committee: settled case law; Chamber: all other cases."}
#: Codes of the keywords and what they stand for (fixed values).
KEYWORDS = {
    "350": "(Art. 3) Prohibition of torture", "89": "(Art. 3) Degrading punishment", "90": "(Art. 3) Degrading treatment", "596": "(Art. 3) Effective investigation", "620": "(Art. 3) Expulsion",
    "618": "(Art. 3) Extradition", "192": "(Art. 3) Inhuman punishment", "193": "(Art. 3) Inhuman treatment", "633": "(Art. 3) Positive obligations", "492": "(Art. 3) Torture",
}
_CASE = "You are shown {shown} of a communicated case.\n{levels}\n{examples}\n{task}\n{unsure}\nAnswer in JSON with the schema {schema}.\nThe case: {text}\n{steps}"
#: Of each family its template and the task that it sets.
FAMILIES = {
    "importance_by_name": ("{source}\nGive the importance of the case: key_case, 1, 2 or 3.\n{unsure}\nAnswer in JSON with the schema {schema}.\nThe case is {name}, with the application numbers {appnos}.", ""),
    "importance": (_CASE, "Predict the importance of the case: key_case, 1, 2 or 3."),
    "difficulty": (_CASE, "Predict whether the case is Easy or Hard."),
    "court": (_CASE, "Predict whether a Judgment or a Decision follows."),
    "chamber": (_CASE, "Predict the formation that decides the case."),
    "keywords": (_CASE, "Give the numbers of the keywords that fit; all of these cases have 350."),
    "summary_communicated": ("Summarise the key facts of this communicated case, once in 200 and once in 500 words.\nAnswer in JSON with the schema {schema}.\nThe case: {text}", ""),
    "summary_one": ("Summarise this communicated case, its subject matter and the questions put to the parties, in your own words.\nAnswer in JSON with the schema {schema}.\nThe case: {text}", ""),
    "summary_outcome": ("Summarise the key facts and the law of this decided case, once in 200 and once in 500 words.\nAnswer in JSON with the schema {schema}.\nThe case: {text}", ""),
}
#: The variants of a question by name: whether the database is named, whether the model must consult it, whether it may be unsure.
BY_NAME = {"first": (False, False, True), "second": (True, False, True), "third": (True, False, False), "fourth": (False, False, False), "fifth": (True, True, False)}


def render(template: Column, **fields: Column) -> Column:
    """``{name}`` replaced by each field's value (null as the empty text)."""
    for name, value in sorted(fields.items()):
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def select_text(selector: Column, subject: Column, questions: Column, summary: Column | None = None) -> Column:
    """1 subject, 2 questions, 3 both (null if either is), 4 summary; null for other selectors."""
    both = F.concat(subject, F.lit(" "), questions)
    return F.when(selector == 1, subject).when(selector == 2, questions).when(selector == 3, both).when(selector == 4, summary if summary is not None else F.lit(None).cast("string"))


def template(family: str, schema: str, text: int = 3, variant: str = "first", unsure: bool = True, few_shot: bool = False, steps: bool = False, grand_chamber: bool = True, families: dict = FAMILIES) -> str:
    """The template of one configuration, with ``{name} {appnos} {text} {examples}`` still open.

    An unknown family, variant or text selector raises, as does selector 4 for a family other than importance.
    """
    if family not in families:
        raise ValueError(f"no prompt family {family}")
    if text not in SHOWN or (text == 4 and family != "importance"):
        raise ValueError(f"text selector {text} is not for {family}")
    out, task = families[family]
    named, consult, may = BY_NAME[variant] if family == "importance_by_name" else (False, False, unsure)
    source = "Look the case up in the court's database." if consult else "Importance is part of the metadata in the court's database." if named else "Importance is given to every case after its outcome."
    levels = {"importance": LEVELS, "difficulty": HARDNESS, "court": COURTS, "chamber": FORMATIONS[grand_chamber], "keywords": "; ".join(f"{k}: {v}" for k, v in KEYWORDS.items())}.get(family, "")
    values = {"shown": SHOWN[text], "levels": levels, "task": task, "unsure": UNSURE if may else "", "schema": schema, "source": source, "steps": "Give your reasons step by step." if steps else ""}
    for k, v in values.items():
        out = out.replace("{" + k + "}", v)
    return out if few_shot else out.replace("{examples}", "")


def prompt(family: str, schema: str, fields: dict[str, Column], examples: Column | None = None, **options) -> Column:
    """The prompt of each row; ``fields`` are columns for the open places, null as the empty text."""
    open_places = fields | ({"examples": examples} if examples is not None else {})
    return render(F.lit(template(family, schema, few_shot=examples is not None, **options)), **open_places)


def family_of(kind: Column) -> Column:
    """Which family a request's kind asks for: the binary kinds by name, all others the importance."""
    return F.when(kind == "binary_difficulty", "difficulty").when(kind == "binary_court", "court").when(kind == "chamber_court", "chamber").otherwise("importance")


def examples_by_label(label: Column, text: Column, order: Column) -> Column:
    """An aggregate: ``label: text`` of each example, in order, joined by ``; ``."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), label.cast("string").alias("l"), text.alias("t")))), lambda x: F.concat_ws(": ", x["l"], x["t"])), "; ")


def examples_by_keywords(text: Column, keywords: Column, order: Column) -> Column:
    """An aggregate: each distinct example text with the keywords of its last row, in order of its first."""
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t"), F.array_join(keywords, ", ").alias("k"))))
    last = lambda t: F.element_at(F.filter(rows, lambda y: y["t"] == t), -1)["k"]
    return F.array_join(F.transform(F.array_distinct(F.transform(rows, lambda x: x["t"])), lambda t: F.concat(F.lit("Example: "), t, F.lit("; Keywords: "), last(t))), " ")


def token_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float, batch: float = 0.5, rate: float = 0.78) -> tuple[Column, Column]:
    """Dollars and pounds; prices a million tokens, halved for batches, one exchange rate (pounds a dollar)."""
    dollars = (tokens_in * price_in + tokens_out * price_out) / 1e6 * batch
    return dollars, dollars * rate


#: Dollars for a million tokens in and out (fixed values).
PRICES = {"gpt-4": (10.0, 30.0), "gpt-4o": (5.0, 15.0)}


def text_cost(rows: Column, subject_tokens: Column, question_tokens: Column, model: str = "gpt-4o", zero_shot: bool = True) -> dict[str, Column]:
    """Of a set of cases (counts and sums of tokens): tokens in and out, dollars, and dollars of an ablation with twice the runs.

    A request adds 3 tokens, and its prompt 300, or 3000 with examples; 500 come back. An ablation pays the prompts once more
    and the answers twice.
    """
    extra, (price_in, price_out) = 300 if zero_shot else 3000, PRICES[model]
    into, out = subject_tokens + question_tokens + rows * (3 + extra), rows * 500
    dollars = lambda i, o: (i * price_in + o * price_out) / 1e6 / 2
    return {"tokens_in": into, "tokens_out": out, "usd": dollars(into, out), "ablation_usd": dollars(into + rows * extra, out * 2)}


def request_cost(field_tokens: Column, names: Column, out: int = 15, model: str = "gpt-4o", rate: float = 0.78) -> dict[str, Column]:
    """Of one request: tokens in (those of the message's fields, 3 for the message, 3 for the answer, 1 for a name), tokens out, pounds."""
    price_in, price_out = PRICES[model]
    into = field_tokens + 6 + names
    return {"tokens_in": into, "tokens_out": F.lit(out).cast("long"), "gbp": (into * price_in + out * price_out) / 1e6 / 2 * rate}
