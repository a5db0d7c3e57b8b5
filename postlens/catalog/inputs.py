"""The given tables seen as postings and résumés.

There is no posting table, so columns of the given ones play its part. Each derived column is one
SQL expression that Spark and DuckDB both understand, and both sides are built from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.session import spread, spread_small
from postlens.taxonomy import Taxonomy

# Terms for the invented prose of `documents` and `conversations`.
PROSE_TERMS: Taxonomy = {
    "Articles": {
        "the": [r"\bthe\b"],
        "la/le": [r"\bla\b", r"\ble\b"],
        "der/die": [r"\bder\b", r"\bdie\b"],
        "un": [r"\bun\b", r"\bune\b"],
        "el": [r"\bel\b"],
    },
    "Verbs": {
        "is": [r"\bis\b"],
        "was": [r"\bwas\b"],
        "are": [r"\bare\b"],
        "est": [r"\best\b"],
    },
    "Stems": {
        "tion+ing": [r"\btion(?=.*(ing|ment))"],
        "thanedble": ["thanedble"],
        "anea": ["anea", "aned"],
        "ción": ["ción"],
        "eau": ["eaux", "eauen"],
        "ungen": ["ungen"],
        "onwhor": ["onwh", "whor"],
        "heble": ["heble"],
        "ouer": [r"\bouer", "rouer"],
    },
    "Links": {
        "that": [r"\bthat\b"],
        "which": [r"\bque\b", r"\bqui\b"],
        "from": [r"\bfrom\b"],
        "with": [r"\bwith\b", r"\bmit\b", r"\bavec\b"],
        "nicht": [r"\bnicht\b", r"\bpas\b"],
    },
    "Noise": {
        "idiot": ["idiot", "clown"],
        "token": ["token"],
        "license": ["license", "copyright"],
        "!!": ["!!"],
    },
}

# Function words of the documents' four languages, as the stop list for their features.
PROSE_STOPS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "de des du est et la le les ou par pas pour que qui sur un une "
    "das dem den der die ein ist mit nicht und von zu "
    "con del el en las los para por se y"
).split()

# Wordings put into the derived role postings, some of them near misses.
_MENTIONS = (
    "Python|SQL|R for statistics|R Programming|Java|JavaScript|Java and JavaScript|Scala|"
    "scalable systems|C++|machine learning|ML models|deep learning|DL|sklearn|pandas|NumPy|"
    "PyTorch|torch|TensorFlow|Keras|XGBoost|statistical tests|A/B testing|time-series|"
    "computer vision|CV and image work|reinforcement learning|LLM|large language models|GenAI|"
    "RAG|fine-tuning|prompt design|LangChain|llama index|Llama|LangGraph|AutoGPT|CrewAI|"
    "Hugging Face|transformers|BERT|GPT-4|OpenAI|Claude|Mistral|Gemini|agentic work|agents for AI|"
    "embeddings|semantic search|vector db|Pinecone|Weaviate|FAISS|Chroma DB|NLP|MLOps|ML Ops|"
    "Docker|k8s|MLflow|Kubeflow|Airflow|git|digital tools|CI/CD|AWS|Azure|Google Cloud|Spark|"
    "Hadoop|ETL|Postgres|MongoDB|NoSQL|data engineering|Tableau|Power BI|Excel|excellent work"
)
_N = _MENTIONS.count("|") + 1


def _mention(index: str) -> str:
    return f"split_part('{_MENTIONS}', '|', cast(1 + ({index}) % {_N} as int))"


_BAND = """case p_partkey % 7
    when 0 then concat(p_size % 9, '-', p_size % 9 + 2, ' years')
    when 1 then concat(p_size % 9, ' to ', p_size % 9 + 3, ' Years')
    when 2 then concat(p_size % 9, '+ years')
    when 3 then concat('Minimum of ', p_size % 9, ' years')
    when 4 then concat(p_size % 9, ' years')
    when 5 then concat(p_size % 9, '+ years or 1 - 4+ years')
    else 'any background' end"""

_INTRO = """case when p_brand = 'Brand#5' and p_size % 50 = 49 then ''
    when p_brand in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') then
    concat('<p>About ', p_brand, ' &amp; friends: we’ve made parts for every workshop in the ',
           'region – and for a long time.</p> ') else '' end"""

_TAIL = """case p_partkey % 4 when 0 then '.' when 1 then '…' when 2 then '...  ' else '' end"""

# A posting per part. Brand is the company, type and name make the title.
ROLE_COLUMNS = {
    "source": "split_part('board|listing|search', '|', cast(1 + p_size % 3 as int))",
    "query": "p_type",
    "job_id": "cast(p_partkey as varchar(20))",
    "title": "concat(p_type, ' ', p_name)",
    "company": "case when p_partkey % 40 = 39 then null else p_brand end",
    "experience": "cast(null as varchar(20))",
    "location": "case when p_size % 5 = 0 then null else concat('Site ', p_size % 5) end",
    "description_snippet": f"""concat({_INTRO}, 'This role needs <b>', {_mention("p_partkey")},
        '</b>,  ', {_mention("p_partkey * 7 + p_size")}, ' and ',
        {_mention("p_partkey * 13 + 5 * p_size")}, chr(10), 'and also ',
        {_mention("p_partkey * 29 + 11")}, '; ', {_BAND}, ' &quot;hands on&quot; ',
        repeat(concat(p_name, ' '), cast(p_size as int)), 'team', {_TAIL})""",
    "posted_date": "cast(null as varchar(20))",
    "url": "concat('https://jobs.example.com/', p_partkey)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are worked on row by row."""
    return spread(table(spark, sf_dir, name))


def select_sql(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


def _derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def role_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw postings derived from `part`."""
    return _derive(spread_small(table(spark, sf_dir, "part")), ROLE_COLUMNS)


ROLE_SQL = select_sql(ROLE_COLUMNS, "part")

# A posting per document: its source is the company, its first line the title.
DOCUMENT_COLUMNS = {
    "posting_id": "doc_id",
    "source": "source",
    "company": "source",
    "location": "lang",
    "title": "split_part(text, chr(10), 1)",
    "description_clean": "text",
}


def document_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(texts(spark, sf_dir, "documents"), DOCUMENT_COLUMNS)


DOCUMENT_SQL = select_sql(DOCUMENT_COLUMNS, "documents")

# A posting per page: its host is the company.
PAGE_COLUMNS = {
    "page_id": "page_id",
    "company": "regexp_extract(url, '^[a-z]+://([^/]+)', 1)",
    "description_clean": "html",
}


def page_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(texts(spark, sf_dir, "pages"), PAGE_COLUMNS)


PAGE_SQL = select_sql(PAGE_COLUMNS, "pages")

# A résumé per conversation turn.
RESUME_COLUMNS = {
    "resume_id": "conv_id * 1000 + turn",
    "text": "text",
}


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(texts(spark, sf_dir, "conversations"), RESUME_COLUMNS)


RESUME_SQL = select_sql(RESUME_COLUMNS, "conversations")
