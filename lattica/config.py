"""Behavioural settings of indexing and retrieval, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # splitting
    chunk_tokens: int = 320
    chunk_overlap: int = 64
    # capsules and canonical forms
    max_capsules_per_passage: int = 6
    person_merge: bool = True
    min_freq_lowercase: int = 2
    max_tokens_lowercase: int = 4
    merge_capsules: bool = True
    merge_threshold: float = 0.88
    predicate_free_threshold: float = 0.93
    neighbor_limit: int = 0
    sim_edge_topk: int = 32
    sim_edge_threshold: float = 0.82
    entails_min_sim: float = 0.9
    nli_max_pairs: int = 2000
    cost_entails: float = 0.2
    cost_contradicts: float = 1.0
    # question graphs
    dag_max_nodes: int = 7
    # vectors
    dim: int = 64
    embedder: str = "hashed"
    query_instruction: str = ""
    # candidates
    subq_top_capsule: int = 50
    entity_match_bonus: float = 0.05
    max_questions: int = 4096
    # propagation
    ppr_min_groups: int = 2
    ppr_seed_per_group: int = 4
    hops: int = 2
    max_nodes: int = 5000  # of a question's neighbourhood; 0: no cap
    steps: int = 10
    alpha: float = 0.85
    rrf_k: int = 60
    ppr_rrf_pool: int = 200
    ppr_prize_weight: float = 2.0
    # binding
    binding_candidates: int = 12
    beam: int = 24
    overlap_bonus: float = 0.08
    no_overlap_penalty: float = 0.04
    doc_diversity_bonus: float = 0.08
    repeat_doc_penalty: float = 0.03
    repeat_capsule_penalty: float = 0.02
    induced_max_nodes: int = 6000
    neighbor_expand_sim_top_m: int = 0
    # document ranking
    dense_weight: float = 0.9
    rrf_pool: int = 120
    rrf_weight: float = 5.0
    diversify_pool: int = 200
    diversify_n: int = 5
    diversify_gain: float = 0.06
    jump_top_m: int = 25
    jump_bonus: float = 0.6
    generic_weight: float = 0.35
    generic_threshold: float = 0.85
    mention_from_top: int = 2
    mention_top_m: int = 20
    mention_bonus: float = 0.35
    retrieval_top_k: int = 200
    # reranking by a model
    rerank_top_n: int = 10
    rerank_select: int = 2
    rerank_snippet: int = 320
    # evidence
    max_passages: int = 5
    token_budget: int = 1800
    pool_docs: int = 50
    pool_per_doc: int = 4
    pool_ppr_passages: int = 50
    evidence_dense: float = 0.25
    evidence_gain: float = 0.75
    same_doc_penalty: float = 0.1
    length_penalty: float = 0.0
    leaf_weight: float = 2.0
    seed_top_s: int = 6
    # graph costs
    cost_in_doc: float = 0.05
    cost_in_passage: float = 0.06
    cost_mentions: float = 0.08
    cost_sim: float = 0.35
    cost_same_text: float = 0.1
    allow_sim: bool = False
    strength_eps: float = 1e-6


#: Traversal weight of each edge type in propagation.
TYPE_WEIGHTS = {"mentions": 1.0, "in_passage": 1.0, "in_doc": 0.7, "entails": 0.5, "contradicts": 0.0, "sim": 0.2}
#: Cut-offs at which recall is reported.
RECALL_AT = (1, 2, 5, 10, 20, 30, 50, 100, 150, 200)
