"""Operators on DataFrames."""

from .aggregates import AGGREGATES, aggregate, count_mask, group_sum, sum_of
from .chunked import chunked_filter, chunked_group_report, chunked_group_sum, filter_then_group_sum, repeated_filter_group_sum
from .compression import dict_decode, dict_encode, dict_group_sum, rle_bytes, rle_decode, rle_encode, rle_group_sum
from .joins import asof_join, asof_pairs, hash_join, join_pairs
from .relational import COMPARE, LazyFilter, compact, gather, limit, materialize, scan, sort, top_k
from .windows import rolling

__all__ = [
    "AGGREGATES", "COMPARE", "LazyFilter", "aggregate", "asof_join", "asof_pairs", "chunked_filter", "chunked_group_report", "chunked_group_sum", "compact",
    "count_mask", "dict_decode", "dict_encode", "dict_group_sum", "filter_then_group_sum", "gather", "group_sum", "hash_join",
    "join_pairs", "limit", "materialize", "repeated_filter_group_sum", "rle_bytes", "rle_decode", "rle_encode", "rle_group_sum", "rolling", "scan", "sort", "sum_of", "top_k",
]
