"""Column functions: identifiers, masks, typed values, colours and formats."""
