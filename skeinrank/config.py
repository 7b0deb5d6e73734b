"""Constants that define results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Fixed values of retrieval, routing, audio and evaluation."""

    window_tokens: int = 256
    window_overlap: float = 0.15
    dims: int = 384
    final_k: int = 2
    candidates: int = 20
    rrf_k: int = 60
    sparse_weight: float = 0.3
    grounding: float = 0.0
    guardrail: float = 0.75
    cache_threshold: float = 0.94
    cache_items: int = 5_000
    labels: int = 10_000
    budget_ms: float = 200.0
    eval_chunk: int = 400
    eval_overlap: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    speech_on: float = 0.5
    speech_off: float = 0.35
    silence_ms: int = 200
    frame_ms: int = 30
    smooth_frames: int = 5


DEFAULT = Config()

#: Words that ask for an explanation, and phrases that tell a refusal.
EXPLAINING = (
    "what", "how", "why", "explain", "describe", "tell", "definition", "history", "impact", "effect", "cause", "relationship",
    "क्या", "कैसे", "क्यों", "बताओ", "समझाओ", "परिभाषा", "என்ன", "எப்படி", "ஏன்", "விளக்கு", "ఏమి", "ఎలా", "ఎందుకు", "వివరించు",
)
REFUSALS = (
    "cannot answer", "can't answer", "cannot be answered", "can't be answered", "unable to answer", "not enough information", "insufficient information",
    "not mentioned in the context", "not mentioned in the provided", "not provided in the context", "not found in the context", "not found in the provided",
    "context does not provide", "context does not contain", "context does not mention", "context does not state", "not contain enough information",
    "no information provided", "no information is provided", "based on the provided context, there is no", "cannot be determined from the provided",
    "i do not have enough information", "i don't have enough information", "does not mention", "does not provide", "does not state", "no direct answer",
)

#: Language tags of the speech service.
LANGUAGE_TAGS = (
    ("hi", "hi-IN"), ("ta", "ta-IN"), ("bn", "bn-IN"), ("kn", "kn-IN"), ("ml", "ml-IN"), ("mr", "mr-IN"), ("te", "te-IN"), ("gu", "gu-IN"),
    ("ur", "ur-IN"), ("or", "or-IN"), ("pa", "pa-IN"), ("as", "as-IN"), ("ne", "ne-NP"), ("sa", "sa-IN"), ("en", "en-IN"),
)
DEFAULT_TAG = "en-IN"

#: Words of romanised Tamil, Hindi and Telugu; a word given twice counts twice.
ROMANISED = {
    "ta": """vanakkam eppadi muthalamichar tamil tamilnadu tamilnadin yaar yar enna irukku irukkeenga irukkanga solla solranga ungal ungala
        peyar per nandri kaalai malar ulagil ethanai ethana kandam kandangal purandha pirandha manilam ethu edhu engu enga eppodhu eppothu eppo
        varudam sukandhiram suthanthiram adainthathu desiya paravai vilangu geetham kodi thalaivar kudiyarasu naadu oor manaivi bharathi
        bharathiyar theriyuma solunga pannunga vaanga ponga avaru ivaru nalla romba konjam apdi ipdi epdi""",
    "hi": """namaste kaise pradhan mantri bharat aap kya naam hai hain kaun kahan kitna dhanyawad samay karo janm rajya kiska kisne kab kyun
        kaunsa batao kahiye shukriya""",
    "te": """namaskaram ela unnaru pradhana evaru meeru enti cheppandi ekkada enduku dhanyavadalu janmincharu rashtram enti cheppandi undi
        undhi bagunnara emiti""",
}
