"""engramql: agent-memory analytics on Spark DataFrames.

An append-only episode log, a semantic graph of typed nodes and weighted
edges and an append-only event log, with retrieval, traversal, belief
revision, structure derivation and data-quality operators.  The subpackage
``llm`` holds training-data operators; nothing outside it imports it.
"""
