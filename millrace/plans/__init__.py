"""Plan shapes shared by the operators: scratch tables, one-row lookups,
distributed row numbers, exact quantiles and hash-ordered selection."""
