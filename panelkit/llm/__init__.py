"""Training-data operators: tokenising, scoring, rules, sharding, mixing,
near-duplicate joins and fingerprints over a ``documents`` table.

Nothing outside this subpackage imports it; ``queries.py`` lists what it
registers."""
