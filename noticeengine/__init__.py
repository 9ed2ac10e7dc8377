"""Analytics over operational notices as ordinary DataFrame plans."""
