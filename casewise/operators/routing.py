"""Operational routing of a classified case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.functions.labels import confidence_band
from casewise.functions.text import stripped_or_blank

# What each rule decides. Fields: decision, reason, action, operator_note,
# review_required, queue, badge_tone.
_REFINER_UNUSABLE = (
    "classificação assistida",
    "A previsão baseline está disponível, mas o refinamento generativo não ficou utilizável nesta execução.",
    "Registrar a macro e validar a classe detalhada com apoio humano antes da conclusão.",
    "Priorize uma revisão curta do caso e, no futuro, registre o feedback humano para retroalimentar o fluxo.",
    True,
    "assistida",
    "warning",
)
_UNCERTAIN = (
    "revisão humana",
    "A combinação de baixa confiança ou ambiguidade aumenta o risco de erro operacional.",
    "Enviar o caso para triagem humana antes de confirmar a classificação final.",
    "Use a justificativa da GenAI como apoio, mas trate a decisão final como responsabilidade do operador.",
    True,
    "humana",
    "danger",
)
_PLAUSIBLE = (
    "classificação assistida",
    "A previsão está consistente, mas ainda não é forte o suficiente para automação plena.",
    "Permitir classificação assistida com confirmação rápida do operador.",
    "Confirme a classe detalhada sugerida e sinalize divergências para futura captura de feedback.",
    True,
    "assistida",
    "warning",
)
_URGENT = (
    "classificação automática",
    "Confiança alta com prioridade elevada favorece automação com monitoramento leve.",
    "Registrar automaticamente a classificação e encaminhar para a fila prioritária.",
    "Monitore exceções e capture eventuais correções para ajustar limites de roteamento no futuro.",
    False,
    "prioritária",
    "success",
)
_AUTOMATIC = (
    "classificação automática",
    "Confiança alta e ausência de ambiguidade permitem uma execução mais direta.",
    "Registrar automaticamente a classificação e seguir o fluxo operacional padrão.",
    "Mantenha amostragem de auditoria para futura camada de feedback humano.",
    False,
    "automática",
    "success",
)
_FIELDS = ("decision", "reason", "action", "operator_note", "review_required", "queue", "badge_tone")


def _outcome(values: tuple) -> Column:
    return F.struct(*[F.lit(value).alias(name) for name, value in zip(_FIELDS, values)])


def route(cases: DataFrame, confidence: str = "confidence") -> DataFrame:
    """Add confidence_level, decision, reason, action, operator_note, review_required, queue
    and badge_tone. The first rule that applies decides.

    ``cases`` has the confidence, priority, ambiguous_case, provider and status.
    """
    level = confidence_band(F.col(confidence))
    unusable = (F.col("provider") == "indisponível") | (F.col("status") != "ok")
    chosen = (
        F.when(unusable, _outcome(_REFINER_UNUSABLE))
        .when(F.col("ambiguous_case") | (F.col("confidence_level") == "baixa"), _outcome(_UNCERTAIN))
        .when(F.col("confidence_level") == "media", _outcome(_PLAUSIBLE))
        .when(F.lower(stripped_or_blank(F.col("priority"))) == "alta", _outcome(_URGENT))
        .otherwise(_outcome(_AUTOMATIC))
    )
    routed = cases.withColumn("confidence_level", level).withColumn("_outcome", chosen)
    return routed.withColumns({name: F.col(f"_outcome.{name}") for name in _FIELDS}).drop("_outcome")
