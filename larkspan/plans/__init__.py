"""Plans: predicates, queries, their text forms, paging and dialects."""
