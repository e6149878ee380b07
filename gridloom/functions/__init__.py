"""functions of gridloom."""
