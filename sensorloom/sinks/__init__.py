"""Where rows go: keyed logs, batch folders, reports, tiered archives."""
