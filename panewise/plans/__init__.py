"""Programs: expressions, windows, checks, text form, lowering to one DataFrame plan."""
