"""Jobs: each public function answers one reporting question over whole tables."""
