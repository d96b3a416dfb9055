"""Reports over the shop's tables and change flows on them."""
