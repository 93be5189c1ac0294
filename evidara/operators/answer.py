"""Contexts, prompts and the deterministic template answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that results are compared with.
REFUSAL = "No hay evidencia suficiente en los documentos recuperados para emitir observaciones fundamentadas. Requiere revisión humana."
TEMPLATE_HEAD = "Análisis preliminar (sin modelo de lenguaje — requiere Qwen en Colab):"
SAFE_PHRASE = "requiere revisión humana"
PROMPT_PARTS = ('Fragmento a evaluar:\n"""\n', '\n"""\n\nEvidencia recuperada (guía OCP/OCDS):\n', "\n\nGenera el análisis con el FORMATO obligatorio.")
#: Instructions for a plugged-in model; any text can take their place.
SYSTEM_PROMPT = (
    "Analiza el fragmento solo con la evidencia recuperada. Habla de señales de riesgo, nunca de delitos probados. "
    "Cita indicador y página de cada señal; si la evidencia no basta, dilo. Termina con 'Requiere revisión humana.'"
)

#: Candidates are arrays of structs in rank order with these fields.
CANDIDATE = "array<struct<rank:int,chunk_id:string,indicator_name:string,indicator_code:string,page_start:int,page_end:int,text:string>>"


def _page(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("?"))


def gather(candidates: DataFrame) -> DataFrame:
    """(query_id, candidates): each query's few candidates as one array in rank order."""
    cols = ["rank", "chunk_id", "indicator_name", "indicator_code", "page_start", "page_end", "text"]
    item = F.struct(*[F.col(c) if c in candidates.columns else F.lit(None).alias(c) for c in cols])
    return candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).cast(CANDIDATE).alias("candidates"))


def context(candidates: Column) -> Column:
    """Candidates as cited sources joined by an empty line; empty names and codes have placeholders."""
    some = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    one = lambda c: F.concat(
        F.lit("[Fuente: "), some(c["indicator_name"], "Desconocida"), F.lit(" ("), some(c["indicator_code"], "N/A"), F.lit(", p."), _page(c["page_start"]), F.lit("-"), _page(c["page_end"]), F.lit(")] "), F.coalesce(c["text"], F.lit(""))
    )
    return F.array_join(F.transform(candidates, one), "\n\n")


def prompt(query: Column, candidates: Column) -> Column:
    """The user part of a prompt; the system text is passed apart."""
    a, b, c = PROMPT_PARTS
    return F.concat(F.lit(a), F.coalesce(query, F.lit("")), F.lit(b), context(candidates), F.lit(c))


def template_answer(candidates: Column) -> Column:
    """At most five numbered signals; the refusal without candidates.  A null name or code prints None."""
    none = lambda c: F.coalesce(c, F.lit("None"))
    line = lambda c, i: F.concat(
        (i + 1).cast("string"), F.lit(". Señal de riesgo potencial: "), none(c["indicator_name"]), F.lit(" ("), none(c["indicator_code"]), F.lit(", p."), _page(c["page_start"]), F.lit("-"), _page(c["page_end"]), F.lit("). Requiere revisión humana.")
    )
    lines = F.transform(F.slice(candidates, 1, 5), line)
    return F.when(F.coalesce(F.size(candidates), F.lit(0)) <= 0, F.lit(REFUSAL)).otherwise(F.concat(F.lit(TEMPLATE_HEAD + "\n\n"), F.array_join(lines, "\n")))


def generate(df: DataFrame, model: Callable[[str, str], str], system: str = SYSTEM_PROMPT, query: str = "query", candidates: str = "candidates") -> DataFrame:
    """Add ``answer`` from a plugged-in model(prompt, system), called on Arrow batches."""
    asked = df.withColumn("_prompt", prompt(F.col(query), F.col(candidates)))

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda p: model(p, system))

    return asked.withColumn("answer", call("_prompt")).drop("_prompt")


def is_safe(answer: Column) -> Column:
    """Whether an answer asks for human review."""
    return F.lower(F.coalesce(answer, F.lit(""))).contains(SAFE_PHRASE)


def chat_text(answer: Column, ratio: Column, refusal: Column, citations: Column) -> Column:
    """A result as chat Markdown: at most five citations, sentences cut to 200 characters."""
    some = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    cite = lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), some(c["indicator_code"]), F.lit(" - "), some(c["indicator_name"]), F.lit(" | pag. "), some(c["page_start"]), F.lit("\n   - Frase soportada: "), F.substring(c["sentence"], 1, 200))
    cited = F.when(F.size(citations) > 0, F.concat(F.lit("\n\n**Evidencia recuperada:**\n"), F.array_join(F.transform(F.slice(citations, 1, 5), cite), "\n"))).otherwise("")
    warned = F.when(refusal != "", F.concat(F.lit("\n\n**Aviso:** "), refusal)).otherwise("")
    return F.concat(answer, F.lit("\n\n**Grounding ratio:** "), F.format_string("%.2f", F.bround(ratio.cast("double"), 2)), warned, cited)


def is_askable(message: Column, least: int = 20) -> Column:
    """Messages shorter than ``least`` trimmed characters are not analysed."""
    from evidara.functions.text import strip

    return F.length(strip(F.coalesce(message, F.lit("")))) >= least
