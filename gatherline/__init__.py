"""gatherline: DataFrame operators for grouped, multi-stream behavioural recordings."""
