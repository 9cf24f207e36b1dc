"""factloom: company financial facts as DataFrame plans over all securities at once."""
