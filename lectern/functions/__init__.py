"""Column functions: native expressions first, Arrow UDFs where a text needs a character-level state machine."""
