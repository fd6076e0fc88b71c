"""ragloom: document-retrieval analytics as Spark DataFrame jobs.

Corpus preparation (pages, chunks, languages, embeddings, full-text
postings), batch hybrid search (cover-density lexical rank fused with
cosine similarity), intra-document clustering, answer assembly and
evaluation, each expressed as ``DataFrame -> DataFrame`` functions.
"""

__version__ = "0.1.0"
