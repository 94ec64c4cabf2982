"""DataFrame operators: occurrences, groups, pairs, near-duplicate search, cases, geography, register and ledger."""
