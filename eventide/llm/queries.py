"""Registered queries of this subpackage: the contracts of the operators."""

from __future__ import annotations

from eventide.llm.bpe import bpe_digests
from eventide.llm.common import load
from eventide.llm.hilbert_clusters import cluster
from eventide.llm.langid import language_id
from eventide.llm.line_crf import quality_rules
from eventide.llm.merkle import document_manifest
from eventide.llm.packing import packing
from eventide.llm.pii import pii
from eventide.llm.quality_nn import quality_classifier
from eventide.llm.rp_forest import near_duplicates
from eventide.llm.secrets import secret_scan
from eventide.llm.simhash import simhash_dedup
from eventide.llm.token_files import token_files
from eventide.llm.warc import page_archives

QUERIES = {
    "op1_language_id": lambda s, d: language_id(s, load(s, d, "documents")),
    "op2_embedding_dedup": lambda s, d: near_duplicates(s, load(s, d, "embeddings")),
    "op3_secret_scan": lambda s, d: secret_scan(s, load(s, d, "documents")),
    "op4_bpe": lambda s, d: bpe_digests(s, load(s, d, "documents")),
    "op5_token_files": lambda s, d: token_files(s, load(s, d, "documents")),
    "op6_simhash_dedup": lambda s, d: simhash_dedup(s, load(s, d, "documents")),
    "op7_packing": lambda s, d: packing(s, load(s, d, "documents")),
    "op8_quality_rules": lambda s, d: quality_rules(
        s, load(s, d, "documents"), load(s, d, "labels")),
    "op9_pii": lambda s, d: pii(s, load(s, d, "documents")),
    "op10_quality_classifier": lambda s, d: quality_classifier(
        s, load(s, d, "documents"), load(s, d, "labels")),
    "op11_warc": lambda s, d: page_archives(s, load(s, d, "pages")),
    "op12_merkle": lambda s, d: document_manifest(s, load(s, d, "documents")),
    "op13_hilbert_clusters": lambda s, d: cluster(s, load(s, d, "embeddings")),
}

ORACLES: dict[str, str] = {}
