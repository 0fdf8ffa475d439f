"""Reading and writing tables, and relational tables from registry documents."""
