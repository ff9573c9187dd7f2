"""Plan shapes shared by the operators: running values, range joins, greedy folds in slices."""
