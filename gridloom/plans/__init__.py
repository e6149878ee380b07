"""plans of gridloom."""
