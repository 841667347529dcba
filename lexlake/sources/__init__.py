"""Reading files and pages."""
