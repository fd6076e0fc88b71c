"""Fixed values that results depend on.

Everything here must keep its exact text: language names select the text
search configuration, templates are filled into prompts and compared
verbatim, and the numeric settings are the retrieval defaults.
"""

# --- fixed values: language code -> text search configuration (22 entries) ---
LANGUAGE_CONFIG = {
    "ar": "Arabic",
    "ca": "Catalan",
    "da": "Danish",
    "el": "Greek",
    "en": "English",
    "es": "Spanish",
    "fi": "Finnish",
    "fr": "French",
    "hi": "Hindi",
    "hu": "Hungarian",
    "id": "Indonesian",
    "it": "Italian",
    "lt": "Lithuanian",
    "ne": "Nepali",
    "nl": "Dutch",
    "no": "Norwegian",
    "pt": "Portuguese",
    "ro": "Romanian",
    "ru": "Russian",
    "sv": "Swedish",
    "ta": "Tamil",
    "tr": "Turkish",
}
FALLBACK_CONFIG = "simple"

# --- fixed values: retrieval settings ---
CHUNK_SIZE = 512
CHUNK_OVERLAP = 10
LEXICAL_CANDIDATES = 100
SEMANTIC_CANDIDATES = 100
LEXICAL_WEIGHT = 0.3
SEMANTIC_WEIGHT = 1.0
SCORE_THRESHOLD = 0.92
FUSED_TOP = 20
RERANK_TOP = 10
CLUSTER_CANDIDATES = 20
VECTOR_DIM = 1024
CENTROID_WEIGHTS = (0.7, 0.3)
COVER_WEIGHT = 0.1  # default weight of an unlabelled lexeme position in cover density ranking
MAX_FILE_NAME = 220
RECURSIVE_SEPARATORS = ("\n\n", "\n", " ", "")
PASSAGE_PREFIX = "passage: "
QUERY_PREFIX = "query: "
NOISE_LABEL = -1
DEFAULT_CLUSTER_ID = "-1"

# --- fixed values: answer assembly texts ---
NO_DOCS_TEMPLATE = (
    "I'm sorry but I could not find any relevant documents to answer your query.\n"
    "Try rephrasing the query or ask me something more specific.\n"
    "If you want a more in-depth explanation of the previous answer, take up the question you asked and ask me explicitly."
)
EMPTY_QUERY_REPLY = "⚠️ Empty user message. Please write a question for me!"
CONTEXT_HEADER = "\nExtracted documents:\n"
CONTEXT_ITEM = "Document {i}\n"
NO_HISTORY = "No previous conversation."
NO_EXPLANATION = "Nessuna spiegazione disponibile."
SOURCE_LINE_PREFIX = "🔹 "
EXPLANATION_LINE_PREFIX = "🔸 "
TITLE_CHARS = 70
VIEWER_BASE_URL = "http://localhost:8080/viewer.html"
EXPLAIN_CHUNKS_PER_SOURCE = 3
SOURCE_PAGE_LABEL = "Pagina"
NO_SOURCES = "null"

CHAT_SYSTEM_WITH_CONTEXT = (
    "You are an AI assistant specialized in answering questions based on the past history and the provided context.\n"
    "Follow these guidelines:\n"
    "- Use only the given context and previus coversation to generate your answer.\n"
    "- Provide a clear and relevant response. Avoid unnecessary details.\n"
    "- Do NOT mention the context, sources, or any document references in your response.\n"
    "- If you cannot answer reply with exactly the following message:\n"
    "\"" + NO_DOCS_TEMPLATE + "\"\n"
)
CHAT_USER_WITH_CONTEXT = (
    "Previous conversation:\n{chat_history}\n---\nHere is the relevant context:\n{context}\n---\n"
    "Now, answer the following question based strictly on the context and on previous conversation .\n\n"
    "Question: {question}"
)
CHAT_SYSTEM_NO_CONTEXT = (
    "You are an AI assistant specialized in answering questions based on the past history and past context."
    "Provide a clear and relevant response. Avoid unnecessary details.\n"
)
CHAT_USER_NO_CONTEXT = (
    "Previous conversation:\n{chat_history}\n---\n"
    "Now, answer the following question based on previous conversation and your konwladge .\n\n"
    "Question: {question}"
)
EVAL_SYSTEM_WITH_CONTEXT = (
    "You are an AI assistant specialized in answering questions based on the provided context.\n"
    "Follow these guidelines:\n- Use only the given context to generate your answer.\n"
    "- Provide a clear and relevant response. Avoid unnecessary details.\n"
    "- Do NOT mention the context, sources, or any document references in your response."
)
EVAL_USER_WITH_CONTEXT = (
    "Here is the relevant context:\n{context}\n---\n"
    "Now, answer the following question based strictly on the context.\n\nQuestion: {question}"
)
EVAL_SYSTEM_NO_CONTEXT = (
    "You are an AI assistant specialized in answering questions based on the past history."
    "Provide a clear and relevant response. Avoid unnecessary details.\n"
)
EVAL_USER_NO_CONTEXT = "Now, answer the following question based on your konwladge .\n\nQuestion: {question}"
EXPLAIN_SYSTEM = (
    "You are a helpful assistant that explains why each document was considered relevant. "
    "For each document, answer exactly in the following format:\n"
    "Document: file_name.pdf\n"
    "Explanation: explanation text here\n\n"
    "Repeat for each document."
)
EXPLAIN_USER_HEAD = "Given the user query:\n\n{query}\n\nExplain why each document is relevant:\n"
EXPLAIN_USER_ITEM = "\nDocument: {source}\nContents:\n{contents}\n---"

# Whitespace as Python's str.split()/strip() see it, written so that Java
# regex and RE2 (DuckDB) read it the same way.
WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
# Token characters of the full-text parser.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
