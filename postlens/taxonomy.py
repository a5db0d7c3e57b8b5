"""The skill table and how its patterns are matched on the JVM."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from postlens import schemas

Taxonomy = dict[str, dict[str, list[str]]]

# Category -> skill -> patterns, any of which marks the skill.
ROLE_SKILLS: Taxonomy = {
    "Programming Languages": {
        "Python": ["python"],
        "SQL": ["sql"],
        "R": [r"\br\b(?=.*(stat|programming|language))", "r programming", "r language"],
        "Java": ["java(?!script)"],
        "Scala": [r"\bscala\b"],
        "C++": [r"c\+\+"],
    },
    "Core ML / DS": {
        "Machine Learning": ["machine learning", r"\bml\b"],
        "Deep Learning": ["deep learning", r"\bdl\b"],
        "scikit-learn": ["scikit-learn", "sklearn"],
        "Pandas": ["pandas"],
        "NumPy": ["numpy"],
        "PyTorch": ["pytorch", "torch"],
        "TensorFlow": ["tensorflow"],
        "Keras": ["keras"],
        "XGBoost": ["xgboost"],
        "Statistics": ["statistics", "statistical"],
        "A/B Testing": ["a/b testing", "ab testing"],
        "Time Series": ["time series", "time-series"],
        "Computer Vision": ["computer vision", r"\bcv\b(?=.*(image|vision))"],
        "Reinforcement Learning": ["reinforcement learning"],
    },
    "GenAI / LLM": {
        "LLM": [r"\bllm\b", "large language model"],
        "Generative AI": ["generative ai", "genai", "gen ai"],
        "RAG": [r"\brag\b", "retrieval augmented generation", "retrieval-augmented generation"],
        "Fine-tuning": ["fine-tun", "finetun"],
        "Prompt Engineering": ["prompt engineering", "prompt design"],
        "LangChain": ["langchain"],
        "LlamaIndex": ["llamaindex", "llama index"],
        "LangGraph": ["langgraph"],
        "AutoGPT": ["autogpt"],
        "CrewAI": ["crewai", "crew ai"],
        "Hugging Face": ["hugging face", "huggingface"],
        "Transformers": ["transformer"],
        "BERT": [r"\bbert\b"],
        "GPT-4": ["gpt-4", "gpt4"],
        "OpenAI API": ["openai api", "openai"],
        "Claude / Anthropic": ["claude", "anthropic"],
        "Llama (Meta)": [r"\bllama\b(?!index)"],
        "Mistral": ["mistral"],
        "Gemini": ["gemini"],
        "Agents": ["ai agent", "agentic", r"\bagents?\b(?=.*(ai|llm|autonomous))"],
        "Embeddings": ["embedding"],
        "Semantic Search": ["semantic search"],
        "Vector Database": ["vector database", "vector db", "vector store"],
        "Pinecone": ["pinecone"],
        "Weaviate": ["weaviate"],
        "FAISS": ["faiss"],
        "ChromaDB": ["chromadb", "chroma db"],
        "NLP": [r"\bnlp\b", "natural language processing"],
    },
    "MLOps / Infra": {
        "MLOps": ["mlops", "ml ops"],
        "Docker": ["docker"],
        "Kubernetes": ["kubernetes", r"\bk8s\b"],
        "MLflow": ["mlflow"],
        "Kubeflow": ["kubeflow"],
        "Airflow": ["airflow"],
        "Git": [r"\bgit\b"],
        "CI/CD": ["ci/cd", "continuous integration"],
    },
    "Cloud": {
        "AWS": [r"\baws\b", "amazon web services"],
        "Azure": [r"\bazure\b"],
        "GCP": [r"\bgcp\b", "google cloud"],
    },
    "Data Engineering": {
        "Spark": ["spark"],
        "Hadoop": ["hadoop"],
        "ETL": [r"\betl\b"],
        "PostgreSQL": ["postgresql", "postgres"],
        "MongoDB": ["mongodb"],
        "NoSQL": ["nosql"],
        "Data Engineering": ["data engineering"],
    },
    "BI / Visualization": {
        "Tableau": ["tableau"],
        "Power BI": ["power bi", "powerbi"],
        "Excel": [r"\bexcel\b(?!lent|s\b)"],
    },
}

# The skill pairs compared side by side, one list per comparison.
ROLE_PAIRS = {
    "LangChain vs LlamaIndex": [("LangChain", "LlamaIndex")],
    "RAG vs Fine-tuning": [("RAG", "Fine-tuning")],
    "Python vs SQL": [("Python", "SQL")],
    "PyTorch vs TensorFlow": [("PyTorch", "TensorFlow")],
    "Cloud Platform Mentions": [("AWS", "Azure"), ("Azure", "GCP")],
}

_WORD = r"[\p{L}\p{N}_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_OPENING_WORD = re.compile(r"^\\b(\w+)(?![?*{])")
_OPENING_EDGE = re.compile(r"\\b(?=\w(?![?*{]))")
_CLOSING_EDGE = re.compile(r"(?:(?<=\w)(?<!\\\w)|(?<=\w\?)(?<!\\\w\?))\\b")
_LITERAL = re.compile(r"(?:[^\\.^$*+?{}\[\]|()]|\\[^\w\s])+")
_HEAD = re.compile(r"(?:\\b)?([\w /-]+)([?*{]?)")
_AHEAD = re.compile(r"\(\?=\.\*\(([\w |]+)\)\)")


@dataclass(frozen=True)
class Term:
    """One pattern, ready to match on folded text.

    Of each group in `needles` at least one string must occur. `regex` must then match too, unless
    the needles alone decide.
    """

    needles: tuple[tuple[str, ...], ...]
    regex: str | None

    @property
    def kind(self) -> str:
        return "literal" if self.regex is None else "regex"


def jvm_regex(pattern: str) -> str:
    """Give a Python-style pattern its Python meaning in java.util.regex, on folded text.

    Word characters are letters, numbers and '_' (Java's own also count combining marks); white
    space takes in the four ASCII separators; '.' stops at '\\n' only. A word edge whose one side is
    known needs only the other side looked at, and an edge before an opening word is looked at once
    the word is found, so that the search is for the word. A pattern without capitals needs no case
    flag.
    """
    flags = "(?Ud)" if pattern == pattern.lower() else "(?iUd)"
    pattern = _CLOSING_EDGE.sub(lambda m: f"(?!{_WORD})", pattern)
    pattern = _OPENING_WORD.sub(lambda m: f"{m[1]}(?<!{_WORD}{m[1]})", pattern)
    pattern = _OPENING_EDGE.sub(lambda m: f"(?<!{_WORD})", pattern)
    for python, java in ((r"\b", _EDGE), (r"\w", _WORD), (r"\s", r"[\s\x1c-\x1f]")):
        pattern = pattern.replace(python, java)
    return flags + pattern


def python_regex(regex: str) -> str:
    """What `jvm_regex` gave, in Python's own terms: its word characters are the same, `.` stops at
    '\\n' only."""
    flags, body = ("(?i)", regex.removeprefix("(?iUd)")) if regex.startswith("(?i") \
        else ("", regex.removeprefix("(?Ud)"))
    return flags + body.replace(_WORD, r"\w")


def compile_term(pattern: str) -> Term:
    if _LITERAL.fullmatch(pattern):
        return Term(((re.sub(r"\\(.)", r"\1", pattern).lower(),),), None)
    needles = []
    head = None if "|" in re.sub(r"\([^()]*\)", "", _AHEAD.sub("", pattern)) \
        else _HEAD.match(pattern)
    if head:
        word = head.group(1)[:-1] if head.group(2) else head.group(1)
        needles += [(word.lower(),)] if word else []
        needles += [tuple(g.lower().split("|")) for g in _AHEAD.findall(pattern)]
    return Term(tuple(needles), jvm_regex(pattern))


def compile_taxonomy(taxonomy: Taxonomy) -> dict[str, list[Term]]:
    """Skill -> terms, in skill-name order."""
    flat = {skill: patterns for skills in taxonomy.values() for skill, patterns in skills.items()}
    return {skill: [compile_term(p) for p in flat[skill]] for skill in sorted(flat)}


def taxonomy_table(spark: SparkSession, taxonomy: Taxonomy = ROLE_SKILLS) -> DataFrame:
    """One row per pattern."""
    rows = [
        (skill, category, pattern, compile_term(pattern).kind)
        for category, skills in taxonomy.items()
        for skill, patterns in skills.items()
        for pattern in patterns
    ]
    return spark.createDataFrame(rows, schemas.TAXONOMY)


def category_table(spark: SparkSession, taxonomy: Taxonomy = ROLE_SKILLS) -> DataFrame:
    """One row per skill."""
    rows = [(skill, category) for category, skills in taxonomy.items() for skill in skills]
    return spark.createDataFrame(rows, "skill string, category string")
