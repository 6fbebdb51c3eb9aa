"""Selector templates and site extraction profiles, as data for the node extraction operator."""

# Selector columns of a template row, in schema order.
TEMPLATE_FIELDS = [
    "list_container", "product_selector", "title_selector", "price_selector",
    "price_fraction_selector", "image_selector", "rating_selector",
    "review_count_selector", "link_selector", "product_id_attribute",
]

# Selectors used where a template has no entry at all (None).
MISSING_SELECTORS = {
    "title_selector": "h2, h3",
    "price_selector": ".price",
    "rating_selector": ".rating",
    "review_count_selector": ".reviews, .review-count",
    "image_selector": "img",
    "link_selector": "a",
}

# Default templates; "" as site stands for every other site.
DEFAULT_TEMPLATES = {
    "amazon": {
        "list_container": "ul.s-result-list > li",
        "product_selector": "[data-asin]",
        "title_selector": "span.a-text-normal, h2 a span",
        "price_selector": "span.a-price-whole",
        "price_fraction_selector": "span.a-price-fraction",
        "image_selector": "img.s-image",
        "rating_selector": "i.a-icon-star-small .a-icon-alt",
        "review_count_selector": "span.a-size-small.a-link-normal",
        "link_selector": "h2 a",
        "product_id_attribute": "data-asin",
    },
    "walmart": {
        "list_container": "div.search-result-gridview-item",
        "product_selector": "div.search-result-gridview-item",
        "title_selector": "div.search-result-product-title a span",
        "price_selector": "span.price-main-block span",
        "image_selector": "img.search-result-image",
        "rating_selector": "span.search-result-star-rating",
        "review_count_selector": "span.search-result-review-count",
        "link_selector": "div.search-result-product-title a",
    },
    "": {
        "list_container": "li.product, div.product-item, div[itemtype*='Product']",
        "product_selector": "li.product, div.product-item",
        "title_selector": "h2, h3, .product-title, .title",
        "price_selector": ".price, .product-price, [class*='price']",
        "image_selector": "img[class*='product'], img[class*='thumbnail']",
        "rating_selector": ".rating, .stars, [class*='star']",
        "review_count_selector": ".reviews, .review-count",
        "link_selector": "a[href*='product'], a.product-link",
    },
}

# Item cap of template extraction, part of the feature.
ITEMS_PER_PAGE = 20

# Profile -> (item, link, title, title fallback, price, price fallback, address prefix).
# An empty prefix means the absolute address of the link is used.
SITE_PROFILES = {
    "ebay": ("[data-listingid]", 'a[href*="/itm/"]', "h3", '[class*="title"]', '[class*="price"]', "", ""),
    "target": ('a[href*="/A-"], a[href*="/p/"]', "", "", "span, div, h2, h3", "", "", "https://www.target.com"),
    "amazon": ("[data-asin]", "", "span.a-text-normal", "h2 a span", ".a-price .a-offscreen", "",
               "https://www.amazon.com/dp/"),
    "walmart": ("[data-item-id]", 'a[href*="/ip/"]', '[data-automation="product-title"]', "span",
                '[itemprop="price"]', "", ""),
    "lowes": ("[data-product-id]", 'a[href*="/p/"]', '[data-testid="product-title"]', "",
              '[data-testid="product-price"]', "", "https://www.lowes.com"),
    "homedepot": ("[data-item-id]", 'a[href*="/p/"]', ".product-header__title", '[data-testid="product-title"]',
                  ".price-format__dollars", '[data-testid="product-price"]', "https://www.homedepot.com"),
    "acehardware": ("[data-product-id]", 'a[href*="/product/"]', ".product-title", "", ".product-price", "",
                    "https://www.acehardware.com"),
    "wayfair": ("[data-product-id]", 'a[href*="/a/s/"]', ".ProductCard-productTitle", "",
                ".ProductCard-price", "", ""),
    "michaels": ("[data-product-id]", 'a[href*="/p/"]', ".product-card__title", "", ".product-card__price", "",
                 "https://www.michaels.com"),
    "temu": ("[data-id]", 'a[href*="/p/"]', ".goods-title", "", ".price", "", "https://www.temu.com"),
    "etsy": ("[data-listing-id]", 'a[href*="/listing/"]', ".wt-text-title-3", "", ".currency-value", "", ""),
    "bestbuy": ("[data-sku-id]", 'a[href*="/site/"]', ".sku-title", "", ".priceView-customer-price", "",
                "https://www.bestbuy.com"),
    "costco": ("[data-product-id]", 'a[href*="/product/"]', ".description", "", ".price", "",
               "https://www.costco.com"),
    "mercadolibre": ("[data-product-id]", 'a[href*="/ML"]', ".poly-component__title", "",
                     ".poly-price__current", "", ""),
    "walmartmexico": ("[data-product-id]", 'a[href*="/mx/"]', ".product-title", "", ".price", "", ""),
    "intexcorp": ("[data-product-id]", 'a[href*="/product/"]', ".product-title", "", ".price", "", ""),
}

# The remaining sites share one shape; they differ in link path and address prefix.
_PLAIN_LINKS = {
    "/p/": ["qvc", "kohls", "meijer", "fivebelow", "samsclub", "dollargeneral", "academy", "familydollar"],
    "/product/": ["bunnings", "action", "wowsports", "coppel", "aosom", "costway"],
}
_PREFIX_EXCEPTIONS = {"bunnings": "https://www.bunnings.com.au", "wowsports": "https://wowsports.com"}
for _path, _sites in _PLAIN_LINKS.items():
    for _site in _sites:
        SITE_PROFILES[_site] = (
            "[data-product-id]", f'a[href*="{_path}"]', ".product-title", "", ".price", "",
            _PREFIX_EXCEPTIONS.get(_site, f"https://www.{_site}.com"),
        )

# Sites whose image comes from src alone; amazon also narrows the image node.
SRC_ONLY_IMAGES = ["amazon", "walmart"]
PROFILE_IMAGE_SELECTORS = {"amazon": "img.s-image"}
