"""Where rows come from: Parquet tables, message logs, replayed files."""
