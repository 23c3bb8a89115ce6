"""Text that a language model is asked with, and the answer that needs none, from ranked evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Texts of answers and prompts.
NO_EVIDENCE = (
    "Sem evidencia suficiente no contexto recuperado para responder com confianca. Tente: (1) deixar a pergunta mais especifica com simbolos/arquivos, "
    "(2) ajustar topK/minScore, (3) revisar filtros de repo/path/language, ou (4) usar knowledgeMode=all para permitir complemento com conhecimento geral."
)
_STRUCTURED = "Prefira respostas detalhadas e estruturadas: resposta direta, explicacao de como funciona no codigo e evidencias (arquivo e linhas)."
_ANALYST = "Voce e um assistente especializado em analisar codigo-fonte."
_ONLY_CONTEXT = "Responda as perguntas do usuario baseando-se APENAS no contexto fornecido."
_NOT_FOUND = "Se a informacao nao estiver no contexto, diga que nao encontrou essa informacao no codigo indexado."
_PORTUGUESE = "Responda em portugues brasileiro."
SYSTEM = {
    "grounded": "\n".join((_ANALYST, _ONLY_CONTEXT, _NOT_FOUND, "Nao invente exemplos nem APIs. Use somente o que aparece nos trechos. Cite os arquivos relevantes.", _STRUCTURED)),
    "all": "\n".join((_ANALYST, "Use o contexto fornecido como evidencia principal quando ele for relevante.", "Se o contexto for insuficiente, responda com conhecimento geral e deixe explicito o que veio do contexto e o que veio de conhecimento geral.", _STRUCTURED, _PORTUGUESE)),
    "strict": "\n".join((_ANALYST, _ONLY_CONTEXT, "Nao use conhecimento externo ao contexto recuperado.", _NOT_FOUND, _STRUCTURED, _PORTUGUESE)),
    "general": "\n".join(("Voce e um assistente especializado em desenvolvimento de software.", "Nenhum trecho relevante foi recuperado do indice nesta pergunta.", "Responda usando conhecimento geral tecnico, de forma objetiva e em portugues brasileiro.", "Quando fizer uma inferencia sem evidencia do repositorio, sinalize isso claramente.")),
}
GROUNDED_HEAD = "Resposta baseada estritamente nas evidencias abaixo:"
NOTHING = "[conteudo nao disponivel]"


def _shown(snippet: Column) -> Column:
    return F.when(F.coalesce(F.trim(snippet), F.lit("")) != "", F.trim(snippet)).otherwise(F.lit(NOTHING))


def _lines(start: Column, end: Column) -> Column:
    return F.concat(F.lit("(linhas "), F.coalesce(start.cast("string"), F.lit("?")), F.lit("-"), F.coalesce(end.cast("string"), F.lit("?")), F.lit(")"))


def _in_order(items: Column) -> Column:
    return F.array_sort(F.collect_list(items))


def grounded_answer(evidence: DataFrame, by: str, position: str = "position") -> DataFrame:
    """One answer per ``by`` that lists its evidence (path, start_line, end_line, snippet) and says nothing else.

    A question has at most a few dozen pieces of evidence, so its list is small.
    """
    item = F.concat(F.lit("- "), F.col("path"), F.lit(" "), _lines(F.col("start_line"), F.col("end_line")), F.lit("\n```\n"), _shown(F.col("snippet")), F.lit("\n```"))
    found = evidence.groupBy(by).agg(_in_order(F.struct(F.col(position), item.alias("item"))).alias("_items"))
    return found.select(by, F.concat(F.lit(GROUNDED_HEAD + "\n\n"), F.array_join(F.transform("_items", lambda x: x["item"]), "\n")).alias("answer"))


def prompt(evidence: DataFrame, by: str, question: str, conversation: str | None = None, position: str = "position") -> DataFrame:
    """The user part of a prompt per ``by``: numbered evidence, the talk so far if there is one, the question."""
    number = lambda i: (i + 1).cast("string")
    part = F.struct(F.col(position), F.col("path"), _lines(F.col("start_line"), F.col("end_line")).alias("lines"), _shown(F.col("snippet")).alias("shown"))
    extra = [F.first(conversation, ignorenulls=True).alias("_talk")] if conversation else []
    found = evidence.groupBy(by).agg(_in_order(part).alias("_items"), F.first(question).alias("_question"), *extra)
    sections = F.array_join(F.transform("_items", lambda x, i: F.concat(F.lit("### Arquivo "), number(i), F.lit(": "), x["path"], F.lit(" "), x["lines"], F.lit("\n\n```\n"), x["shown"], F.lit("\n```"))), "\n\n")
    talk = F.when(F.coalesce("_talk", F.lit("")) != "", F.concat(F.lit("## Contexto da conversa atual:\n"), F.col("_talk"), F.lit("\n\n"))).otherwise(F.lit("")) if conversation else F.lit("")
    return found.select(by, F.concat(F.lit("## Contexto do codigo-fonte:\n\n"), sections, F.lit("\n\n"), talk, F.lit("## Pergunta:\n"), F.col("_question"), F.lit("\n\n## Resposta:")).alias("prompt"))


def answer_kind(n_evidence: Column, grounded: bool, knowledge: str) -> Column:
    """Who answers: general knowledge, the fixed fallback, the evidence itself, or a model with evidence."""
    general = not grounded and knowledge == "all"
    return F.when(n_evidence == 0, F.lit("general" if general else "fallback")).otherwise(F.lit("grounded" if grounded else "model"))


def system_prompt(kind: Column, grounded: bool, knowledge: str) -> Column:
    """The system part of a prompt for who answers; null where no model is asked."""
    mode = "grounded" if grounded else "all" if knowledge == "all" else "strict"
    return F.when(kind == "general", SYSTEM["general"]).when(kind == "model", SYSTEM[mode])


def answers(questions: DataFrame, evidence: DataFrame, by: str, grounded: bool, knowledge: str = "strict") -> DataFrame:
    """by, n_evidence, kind, answer: the text where no model is needed, null where one is asked."""
    listed = grounded_answer(evidence, by).join(evidence.groupBy(by).agg(F.count(F.lit(1)).alias("_n")), by)
    found = questions.select(by).distinct().join(listed, by, "left").withColumn("n_evidence", F.coalesce("_n", F.lit(0)))
    kind = answer_kind(F.col("n_evidence"), grounded, knowledge)
    return found.select(by, "n_evidence", kind.alias("kind"), F.when(kind == "grounded", F.col("answer")).when(kind == "fallback", NO_EVIDENCE).alias("answer"))
