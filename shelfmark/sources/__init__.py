"""Reading raw pages and feeds into book rows."""
